"""Removal of byte strings that a document with a smaller doc_id holds too, decided on suffix arrays.

A repeat is a string of `length` bytes. Windows of that length take the least hash of their 16-byte strings as their key, which is the
same wherever the window stands, so all places of a repeat have one key. Neighbouring windows of one key are a run, and a run's bytes
are its context. Keys that one text alone has are left out, in one shuffle of keys without texts.

Of copies of a whole text only the first is looked at, the others lose all. The contexts of a key meet in one task, each different one
once with its least doc_id. Stretches of them that may have a window in common are classes, and the suffixes of each class's different
stretches are sorted (suffix_array), many classes side by side; suffixes that begin with the same window are neighbours then, and the
least doc_id among them says which documents lose it. A key that more than `crowd` texts have, such as that of a line that a third of all documents have, is not gathered:
each of its windows is a context of its own, and those are grouped by Spark with partial sums.

Nulls and edge cases: a null text is empty, a text shorter than a window keeps all; a row without a doc_id has no smaller one and is no
one's smaller one, so it keeps all; rows that share a doc_id do not remove anything of each other, and every row of the input has a
row in the result. An empty table gives an empty one. Columns beside doc_id and text are not returned, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_batches
from .suffix_array import suffix_arrays

#: Bytes of a key's string, windows that a run has at most, windows that are hashed at once, bytes of contexts that are sorted at once,
#: runs from which a key is put off until there are more such, parts of a window's places that are told apart.
KEY, PIECE, BLOCK, SORTED, MANY, PARTS = 16, 256, 1 << 19, 1 << 24, 1024, 5
#: Bits of a hash that a key has not.
SHIFT = np.uint64(16)


def string_hashes(data: bytes, begin: int, n: int) -> np.ndarray:
    """Hashes of the n KEY-byte strings that begin at `begin` and behind."""
    word = np.ndarray((n + 8,), "<u8", data, begin, (1,))  # a view, the word at every byte
    h = word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ (word[8:] ^ (word[8:] >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_keys(data: bytes, begin: int, end: int, length: int) -> np.ndarray:
    """Keys of the windows that begin at begin..end-1: the least hash of the KEY-byte strings in each."""
    h = string_hashes(data, begin, end - begin + length - KEY)
    span, wide = 1, length - KEY + 1
    while span * 2 <= wide:
        h, span = np.minimum(h[:-span], h[span:]), span * 2
    return np.minimum(h[: len(h) - (wide - span)], h[wide - span :]) if span < wide else h


def runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, text, begin, windows) of the runs of all texts; a run may be cut into several."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data, ends = b"".join(texts), np.cumsum(sizes)
    stops = np.sort(np.concatenate([ends, np.maximum(ends - sizes, ends - length + 1)]))  # no window is whole from the one up to the other
    found = []
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        upto = min(at + BLOCK, len(data) - length + 1)
        key = window_keys(data, at, upto, length)
        edge = np.empty(upto - at, dtype=bool)
        edge[0] = True
        np.not_equal(key[1:], key[:-1], out=edge[1:])
        edge[stops[np.searchsorted(stops, at) : np.searchsorted(stops, upto)] - at] = True  # runs end with their text
        new = np.flatnonzero(edge)
        size = np.diff(np.append(new, upto - at))
        owner = np.searchsorted(ends, at + new, "right")
        whole = at + new + length <= ends[owner]
        key, begin, size, owner = key[new[whole]], at + new[whole], size[whole], owner[whole]
        if not len(key):
            continue
        parts = -(-size // PIECE)  # long runs, as of periodic texts, in pieces
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        of = np.repeat(np.arange(len(key)), parts)
        found.append((key[of], owner[of], (begin - (ends - sizes)[owner])[of] + nth * PIECE, np.minimum(PIECE, size[of] - nth * PIECE)))
    if not found:
        return np.empty(0, dtype=np.uint64), *(np.empty(0, dtype=np.int64) for _ in range(3))
    key, *rest = (np.concatenate(x) for x in zip(*found))
    return key >> SHIFT, *rest  # 48 bits tell keys apart, and others only meet in a group


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def _keys(length: int):
    """Of each batch (ref, text): a row for each key, with a text that has it, the others that have it, if any, and how many they are in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, owner, _, _ = runs(_bytes_of(b.column("text")), length)
            ref = b.column("ref").to_numpy(zero_copy_only=False)[owner] if len(key) else np.empty(0, dtype=np.int64)
            by = np.lexsort((ref, key))
            key, ref = key[by], ref[by]
            one = np.ones(len(key), dtype=bool)
            one[1:] = (key[1:] != key[:-1]) | (ref[1:] != ref[:-1])  # each text once
            key, ref = key[one], ref[one]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
            n = np.diff(np.append(head, len(key)))
            rest = np.ones(len(key), dtype=bool)
            rest[head] = False
            more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n - 1)), pa.int32()), pa.array(ref[rest], pa.int64()), mask=pa.array(n == 1)) if len(head) else pa.array([], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(ref[head], pa.int64()), more, pa.array(n, pa.int32())], ["key", "ref", "more", "n"])

    return run


def _contexts(length: int, crowded: bool):
    """Of each batch (ref, doc_id, first, text, keys), of rows whose doc_id is `first`: the contexts of the runs with one of the row's keys, or
    their windows one by one. (The ids are compared here, as a join on them would deal out all texts once more.)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pc.equal(b.column("doc_id"), b.column("first")))
            texts, wanted = _bytes_of(b.column("text")), b.column("keys")
            key, owner, begin, size = runs(texts, length)
            held, of = wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64), wanted.value_lengths().to_numpy(zero_copy_only=False)
            wide = np.uint64(64) - SHIFT  # a key's bits; above it is the text's number, and what it has too many bits for is kept for nothing
            pairs = held | np.repeat(np.arange(len(texts), dtype=np.uint64), of) << wide
            keep = np.isin(key | owner.astype(np.uint64) << wide, pairs)
            key, owner, begin, size = key[keep], owner[keep], begin[keep], size[keep]
            if crowded:
                nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                key, owner, begin, size = np.repeat(key, size), np.repeat(owner, size), np.repeat(begin, size) + nth, np.ones(size.sum(), dtype=np.int64)
            stop = (begin + size + length - 1).tolist()
            cut = pa.array([texts[t][x:y] for t, x, y in zip(owner.tolist(), begin.tolist(), stop)], pa.binary())
            doc, ref = (b.column(c).to_numpy(zero_copy_only=False)[owner] if len(owner) else np.empty(0, dtype=np.int64) for c in ("doc_id", "ref"))
            for x in range(0, len(cut), 1 << 14):
                y = slice(x, x + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array(key[y].view(np.int64)), cut[y], pa.array(doc[y], pa.int64()), pa.array(ref[y], pa.int64()), pa.array(begin[y], pa.int64())], ["key", "bytes", "doc_id", "ref", "begin"])

    return run


def _places(keys: np.ndarray, data: bytes, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings with their key's hash begin in the contexts that end at `ends`, and in which context each is."""
    n = len(data) - 8 - KEY + 1
    places = [np.empty(0, dtype=np.int64)]
    for at in range(0, n, BLOCK):
        upto = min(at + BLOCK, n)
        x, y = np.searchsorted(ends, [at, upto - 1], "right").tolist()
        wanted = np.repeat(keys[x : y + 1].astype(np.uint64), np.minimum(ends[x : y + 1], upto) - np.maximum((ends - sizes)[x : y + 1], at))
        places.append(at + np.flatnonzero(string_hashes(data, at, upto - at) >> SHIFT == wanted))
    place = np.concatenate(places)
    owner = np.searchsorted(ends, place, "right")
    inside = place + KEY <= ends[owner]
    return place[inside], owner[inside]


def _shared(keys: np.ndarray, contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, first window, windows, class) of the stretches of windows that different contexts may have in common, by class; how many
    places each context's key has in it.

    Every window of a context holds a string with its key's hash, and equal windows hold it at the same place. The places are parted into PARTS
    ranges; all windows with the string in one range have the same bytes around it in common. Those with equal ones are a class.
    """
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    ends, data = np.cumsum(sizes), b"".join(contexts) + bytes(8)
    word = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    place, owner = _places(keys, data, ends, sizes)
    begins, free, found, classes = ends - sizes, length - KEY + 1, [], 0
    for part in range(PARTS):
        before, after = part * free // PARTS, (part + 1) * free // PARTS
        behind = KEY + free - after
        low = np.maximum(place - after + 1, begins[owner])
        high = np.minimum(place - before, ends[owner] - length)
        inside = low <= high
        begin, of = place[inside] - before, owner[inside]
        h = keys.astype(np.uint64)[of]
        for x in [*range(0, before + behind - 8, 8), before + behind - 8]:
            h = (h ^ word[begin + x]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        by = np.lexsort((of, h))
        h, of = h[by], of[by]
        if not len(h):
            continue
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        end = np.append(head[1:], len(h))
        stay = np.repeat(of[head] < of[end - 1], end - head)
        low, high = low[inside][by], high[inside][by]
        found.append((of[stay], (low - begins[of])[stay], (high - low + 1)[stay], classes + np.repeat(np.arange(len(head)), end - head)[stay]))
        classes += len(head)
    found.append(tuple(np.empty(0, dtype=np.int64) for _ in range(4)))
    return *(np.concatenate(x) for x in zip(*found)), np.bincount(owner, minlength=len(contexts))


def alike(keys: np.ndarray, contexts: list[bytes], length: int) -> np.ndarray:
    """Which of different contexts may have a window in common with another one of their key; the others need not be sorted."""
    stay = np.zeros(len(contexts), dtype=bool)
    stay[_shared(keys, contexts, length)[0]] = True
    return stay


def _firsts(groups: np.ndarray, words: list[bytes], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal strings of a group one with the least doc_id, by group; which of these each string is."""
    code = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    by = np.lexsort((ids, code, groups))
    new = np.ones(len(by), dtype=bool)
    new[1:] = (groups[by][1:] != groups[by][:-1]) | (code[by][1:] != code[by][:-1])
    which = np.empty(len(by), dtype=np.int64)
    which[by] = np.cumsum(new) - 1
    return by[new], which


def _alone(groups: np.ndarray) -> np.ndarray:
    """Of sorted groups: which have one member."""
    alone = np.ones(len(groups), dtype=bool)
    same = groups[1:] == groups[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    return alone


def _sorted_ids(groups: np.ndarray, contexts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For different contexts sorted by group: the least doc_id of every window in them, among the contexts of its group, and where each
    context's windows begin in that array. A group is one string to sort."""
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    windows = sizes - length + 1
    first = np.cumsum(windows) - windows
    least = np.repeat(ids, windows)
    many = np.flatnonzero(~_alone(groups))
    if not len(many):
        return least, first
    begins = np.cumsum(sizes[many] + 1) - sizes[many] - 1
    data = np.frombuffer(b"\0".join([contexts[i] for i in many.tolist()]) + b"\0", dtype=np.uint8)
    symbols = data.astype(np.int64) + 1
    symbols[begins + sizes[many]] = 0  # behind each context
    group = np.concatenate([[True], groups[many][1:] != groups[many][:-1]])
    order = suffix_arrays(symbols, np.add.reduceat(sizes[many] + 1, np.flatnonzero(group)))
    context = np.repeat(np.arange(len(many)), sizes[many] + 1)[order]
    inside = order - begins[context]
    starts = np.flatnonzero(inside <= sizes[many][context] - length)
    order, context, inside = order[starts], context[starts], inside[starts]
    shown = np.lib.stride_tricks.sliding_window_view(data, length)
    string = (np.cumsum(group) - 1)[context]
    new = np.ones(len(order), dtype=bool)
    for at in range(1, len(order), BLOCK // 8):
        y = slice(at, min(at + BLOCK // 8, len(order)))
        x = slice(y.start - 1, y.stop - 1)
        new[y] = (shown[order[y]] != shown[order[x]]).any(axis=1) | (string[y] != string[x])
    head = np.flatnonzero(new)
    lowest = np.minimum.reduceat(ids[many][context], head)
    least[first[many][context] + inside] = np.repeat(lowest, np.diff(np.append(head, len(order))))
    return least, first


def least_ids(keys: np.ndarray, contexts: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For different contexts sorted by key, each with its least doc_id: the least doc_id of every window in them, among the contexts of its
    key, and where each context's windows begin in that array.

    What contexts may have in common is sorted class by class, as a class is short where a key is long; of a class's equal stretches one is
    sorted. Contexts of a key whose string stands twice in one of them, as in periodic texts, are sorted whole and together.
    """
    sizes = np.array([len(c) for c in contexts], dtype=np.int64)
    windows = sizes - length + 1
    first = np.cumsum(windows) - windows
    least = np.repeat(ids, windows)
    many = np.flatnonzero(~_alone(keys))
    if not len(many):
        return least, first
    of, begin, count, group, places = _shared(keys[many], [contexts[i] for i in many.tolist()], length)
    twice = np.isin(keys[many], keys[many][places > 1])
    whole = np.zeros(len(many), dtype=bool)
    whole[of[twice[of]]] = True
    whole = many[whole]
    found, at = _sorted_ids(keys[whole], [contexts[i] for i in whole.tolist()], ids[whole], length)
    nth = np.arange(len(found)) - np.repeat(at, windows[whole])
    least[np.repeat(first[whole], windows[whole]) + nth] = found
    once = ~twice[of]
    of, begin, count, group = many[of[once]], begin[once], count[once], group[once]
    words = [contexts[i][x:y] for i, x, y in zip(of.tolist(), begin.tolist(), (begin + count + length - 1).tolist())]
    head, which = _firsts(group, words, ids[of])
    found, at = _sorted_ids(group[head], [words[i] for i in head.tolist()], ids[of[head]], length)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    least[np.repeat(first[of] + begin, count) + nth] = found[np.repeat(at[which], count) + nth]
    return least, first


def _spans(keys: np.ndarray, contexts: pa.Array, docs: np.ndarray, refs: np.ndarray, begins: np.ndarray, length: int) -> pa.RecordBatch:
    """Of all runs of some keys: what each text loses, as spans of bytes."""
    coded = contexts.dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    by = np.lexsort((docs, code, keys))
    new = np.concatenate([[True], (keys[by][1:] != keys[by][:-1]) | (code[by][1:] != code[by][:-1])])
    head = by[new]  # of equal contexts the one with the least doc_id
    least, first = least_ids(keys[head], [words[c] for c in code[head].tolist()], docs[head], length)
    which = np.empty(len(keys), dtype=np.int64)
    which[by] = np.cumsum(new) - 1
    size = np.diff(np.append(first, len(least)))[which]
    found = [(np.empty(0, dtype=np.int64),) * 3]
    for x in range(0, len(keys), BLOCK // 32):  # windows are many more than runs
        part = slice(x, x + BLOCK // 32)
        nth = np.arange(size[part].sum()) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        lost = np.flatnonzero(least[np.repeat(first[which[part]], size[part]) + nth] < np.repeat(docs[part], size[part]))
        if len(lost):
            run, nth = np.repeat(np.arange(len(size[part])), size[part])[lost], nth[lost]
            edge = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (nth[1:] != nth[:-1] + 1)]))
            last = np.append(edge[1:], len(run)) - 1
            found.append((x + run[edge], nth[edge], nth[last] + length))
    run, start, end = (np.concatenate(x) for x in zip(*found))
    return pa.RecordBatch.from_arrays([pa.array(refs[run], pa.int64()), pa.array(docs[run], pa.int64()), pa.array(begins[run] + start, pa.int64()), pa.array(begins[run] + end, pa.int64())], ["ref", "doc_id", "start", "end"])


def _sorted_keys(length: int):
    """Of a partition sorted by key: the spans, whole keys being worked on as soon as there are SORTED bytes of contexts. Keys with many runs
    wait for others of their kind, as a string takes as many steps as it is long and steps of few strings at a time are dear."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        key, doc, ref, begin = (table.column(c).to_numpy() for c in ("key", "doc_id", "ref", "begin"))
        return _spans(key, table.column("bytes").combine_chunks(), doc, ref, begin, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        large: list[pa.Table] = []

        def whole(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            """What can be solved of a table of whole keys and of the large ones that wait."""
            if table.num_rows:
                key = table.column("key").to_numpy()
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                n = np.diff(np.append(head, len(key)))
                big = np.repeat(n >= MANY, n)
                if (~big).any():
                    yield solve(table.filter(pa.array(~big)))
                if big.any():
                    large.append(table.filter(pa.array(big)))
            if large and (last or sum(t.nbytes for t in large) >= SORTED):
                waiting = pa.concat_tables(large)
                large.clear()
                yield solve(waiting)

        for b in batches:
            held.append(b)
            size += b.nbytes
            if size < SORTED or b.column("key")[0] == b.column("key")[b.num_rows - 1] == held[0].column("key")[0]:
                continue
            table = pa.Table.from_batches(held)
            upto = int(np.searchsorted(table.column("key").to_numpy(), table.column("key")[-1].as_py()))  # the last key may go on
            if upto:
                yield from whole(table.slice(0, upto), False)
                held = table.slice(upto).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from whole(pa.Table.from_batches(held), True)

    return run


def _cut(length: int):
    """(doc_id, text, first, spans) -> overlapping spans as one, and the bytes that are left. A copy of the text of a smaller doc_id loses all."""

    def merged(doc: int | None, first: int | None, spans: list | None, size: int) -> list[dict[str, int]]:
        if doc is None or first is None:
            return []
        if doc != first:
            return [{"start": 0, "end": size}] if size >= length else []
        whole: list[dict[str, int]] = []
        for x, y in sorted((s["start"], s["end"]) for s in spans or ()):
            if whole and x <= whole[-1]["end"]:
                whole[-1]["end"] = max(whole[-1]["end"], y)
            else:
                whole.append({"start": x, "end": y})
        return whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for b in batches:
            texts, columns = _bytes_of(b.column("text")), (b.column(c).to_pylist() for c in ("doc_id", "first", "spans"))
            gone = [merged(*r, len(t)) for *r, t in zip(*columns, texts)]
            edges = [[0, *(x for s in g for x in (s["start"], s["end"])), len(t)] for g, t in zip(gone, texts)]
            kept = [b"".join(t[x:y] for x, y in zip(e[::2], e[1::2])) for e, t in zip(edges, texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(gone, pa.list_(span)), pa.array(kept, pa.binary())], ["doc_id", "text", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = 50, crowd: int = 50_000) -> DataFrame:
    """(doc_id, text, spans, kept): each document's UTF-8 bytes, the spans of them that repeat a document with a smaller doc_id, the rest.

    text and kept are binary, as a cut may part a character. Spans are maximal, [start, end) in bytes, in order. length: at least 24.
    """
    if length < KEY + 8:
        raise ValueError(f"length is at least {KEY + 8}")
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns({"ref": F.xxhash64("text"), "sha": F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))})  # never null, so that the joins need no filter and share one shuffle of texts
    known = rows.where("doc_id is not null")
    firsts = keep(known.groupBy("ref", "sha").agg(F.min("doc_id").alias("first")))  # a row for each different text
    keys = known.select("ref", "text").mapInArrow(_keys(length), "key long, ref long, more array<long>, n int")
    over = Window.partitionBy("key")
    counted = keys.select("key", "ref", "more", F.sum("n").over(over).alias("total"), F.max("n").over(over).alias("most"), F.min("ref").over(over).alias("lo"), F.max("ref").over(over).alias("hi"))
    shared = counted.where("lo < hi or most > 1").select(F.explode(F.concat(F.array("ref"), F.coalesce("more", F.expr("cast(array() as array<bigint>)")))).alias("ref"), "key", (F.col("total") > crowd).alias("crowded"))
    lists = shared.groupBy("ref").agg(*(F.collect_set(F.when(F.col("crowded") == yes, F.col("key"))).alias(name) for name, yes in (("usual", False), ("hot", True))))
    lists = keep(lists.join(firsts, "ref"))

    def contexts(name: str) -> DataFrame:
        """Of the first document of each text."""
        own = rows.join(lists.where(F.size(name) > 0).select("ref", "sha", "first", F.col(name).alias("keys")).hint("merge"), ["ref", "sha"])
        return own.select("ref", "doc_id", "first", "text", "keys").mapInArrow(_contexts(length, name == "hot"), "key long, bytes binary, doc_id long, ref long, begin long")

    spans = contexts("usual").repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_keys(length), "ref long, doc_id long, start long, end long")
    if lists.where(F.size("hot") > 0).limit(1).count():
        windows = contexts("hot").drop("key")
        least = windows.groupBy("bytes").agg(F.min("doc_id").alias("_least"))
        lost = windows.join(least.hint("merge"), "bytes").where("_least < doc_id")
        spans = spans.unionByName(lost.select("ref", "doc_id", F.col("begin").alias("start"), (F.col("begin") + length).alias("end")))
    found = spans.groupBy("ref", F.col("doc_id").alias("first")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    of_text = firsts.join(found, ["ref", "first"], "left")
    cut = rows.join(of_text.hint("merge"), ["ref", "sha"], "left").select("doc_id", "text", "first", "spans")
    return cut.mapInArrow(_cut(length), "doc_id long, text binary, spans array<struct<start:long,end:long>>, kept binary")
