"""Language identification by fusing text, declared markup language, address suffix and host priors, as Bayes has it.

The text gives a likelihood by character trigrams, tempered so that a long text is not taken for thousands of independent
observations. What a page declares is a second observation, with a confusion table estimated from all pages. The prior
comes from the address: language shares of the host, smoothed towards those of its domain, these towards those of its
suffix, these towards the global ones, so that a host with few pages says little. All shares are grouped sums of the text
posteriors, without the page's own part. Hosts' tables are joined by host; a host, domain or suffix with a large part of all
rows is looked up where its rows are (common.lookup).

Trigrams are counted over a sample of at most `sample_rows` labelled documents. A null or empty text is as likely in each
language, and the other evidence decides; a missing or malformed declaration and a missing address are values of their
own. Repeated rows each get their row. Null ids stay null. Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BINS, TEMPER, ADDED = 1 << 13, 60.0, 0.5
DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", re.I)
HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|nav|footer|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"<[^>]*>")
#: Labels below a country's suffix under which names are registered.
GENERAL = frozenset("ac co com edu gob gov ltd me mil ne net nom or org plc sch".split())


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams of the lower-case text, white space being one space."""
    codes = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(BINS)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1] * np.uint64(0x85EBCA77) ^ codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return np.bincount((mixed * np.uint64(0x27D4EB2F) >> np.uint64(15)) & np.uint64(BINS - 1), minlength=BINS)


def text_of(page: str) -> str:
    return entities.unescape(TAG.sub(" ", HIDDEN.sub(" ", page)))


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of a URL. Empty strings where there is none.

    The domain is the last two labels of the host, or three where a country's suffix has a general label before it (co.uk); a
    host that is an IP address is its own domain and has no suffix.
    """
    try:
        host = (urlsplit(url or "").hostname or "").rstrip(".")
    except ValueError:
        host = ""
    labels = host.split(".")
    if ":" in host or len(labels) == 4 and all(x.isdigit() for x in labels):
        return host, host, ""
    return host, ".".join(labels[-3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in GENERAL else -2 :]), labels[-1]


class Texts:
    """Tempered posteriors of texts under a uniform prior."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smoothed = counts + ADDED
        self.logs = np.log(smoothed / smoothed.sum(axis=1, keepdims=True))

    def posterior(self, text: str) -> np.ndarray:
        counts = trigram_counts(text)
        n = counts.sum()
        scores = self.logs @ counts * min(1.0, TEMPER / max(1.0, n))
        p = np.exp(scores - scores.max())
        return np.maximum(p / p.sum(), 1e-9)


def learn(labelled: DataFrame, sample_rows: int = 4000) -> Texts:
    """Trigram counts by language of labelled(doc_id, text, lang), from at most sample_rows rows by a hash of doc_id."""
    common.small_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    # ids first: only the chosen rows' texts are read by tasks, where they are
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = labelled.join(F.broadcast(chosen), labelled["doc_id"].eqNullSafe(chosen["doc_id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[lang] = total.get(lang, 0) + trigram_counts(text)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))], names=["lang", "bin", "n"])

    counted = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "lang string, bin int, n long")
    got = counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect()  # at most languages * BINS rows
    languages = sorted({r.lang for r in got}) or ["und"]
    counts = np.zeros((len(languages), BINS))
    for r in got:
        counts[languages.index(r.lang), r.bin] = r.n
    return Texts(languages, counts)


def evidence(rows: DataFrame, texts: Texts, markup: bool) -> DataFrame:
    """rows(id, address, text) -> id, address, host, domain, suffix, declared, p0, p1, ...; for markup, `address` is a URL, else it is the host itself."""
    common.small_batches(rows.sparkSession, 256)
    k = len(texts.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = b.column(2).to_pylist()
            places = [address(a) if markup else (a or "", a or "", "") for a in b.column(1).to_pylist()]
            declared = [m.group(1).lower()[:2] if markup and (m := DECLARED.search(t or "")) else "" for t in body]
            declared = [d if not d or d in texts.languages else "other" for d in declared]
            p = np.stack([texts.posterior(text_of(t or "") if markup else t or "") for t in body]) if body else np.zeros((0, k))
            columns = [b.column(0), b.column(1), *(pa.array([x[j] for x in places], pa.string()) for j in range(3)), pa.array(declared, pa.string()), *(pa.array(p[:, j], pa.float64()) for j in range(k))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "address", "host", "domain", "suffix", "declared", *(f"p{j}" for j in range(k))])

    return rows.mapInArrow(run, "id long, address string, host string, domain string, suffix string, declared string, " + ", ".join(f"p{j} double" for j in range(k)))


def fuse(seen: DataFrame, languages: list[str], weight: float = 5.0) -> DataFrame:
    """evidence() rows with lang, confidence, text_lang and text_confidence. `weight`: pages that a level's parent counts for."""
    ps = [f"p{j}" for j in range(len(languages))]

    def sums(df: DataFrame, by: list[str], name: str, of: list[str]) -> DataFrame:
        return df.groupBy(*by).agg(*(F.sum(c).alias(f"{name}{j}") for j, c in enumerate(of)))

    cols = {n: [f"{n}{j}" for j in range(len(ps))] for n in ("h", "d", "s", "g", "c")}
    hosts = common.keep(sums(seen, ["suffix", "domain", "host"], "h", ps))
    domains = sums(hosts, ["suffix", "domain"], "d", cols["h"])
    suffixes = sums(domains, ["suffix"], "s", cols["d"])
    world = suffixes.agg(*(F.sum(f"s{j}").alias(f"g{j}") for j in range(len(ps))))
    table = common.lookup(common.lookup(hosts, domains, ["suffix", "domain"], ["host"]), suffixes, ["suffix"], ["host"])
    declared = sums(seen, ["declared"], "c", ps)  # at most languages + 2 rows
    rows = common.lookup(seen, table, ["suffix", "domain", "host"], ["id", "address"])
    rows = rows.crossJoin(F.broadcast(world)).join(F.broadcast(declared), "declared")  # world is one row

    def total(xs: list[Column]) -> Column:
        return reduce(Column.__add__, xs)

    shares = [F.lit(1.0 / len(ps)) for _ in ps]
    for level in ("g", "s", "d", "h"):
        own = [F.greatest(F.col(f"{level}{j}") - F.col(p), F.lit(0.0)) for j, p in enumerate(ps)]
        rows = rows.withColumns({f"n_{level}": total(own)} | {f"r_{level}{j}": (own[j] + weight * shares[j]) / (total(own) + weight) for j in range(len(ps))})
        shares = [F.col(f"r_{level}{j}") for j in range(len(ps))]
    kinds = len(ps) + 2
    logs = []
    for j, p in enumerate(ps):
        said = (F.greatest(F.col(f"c{j}") - F.col(p), F.lit(0.0)) + 1.0) / (F.greatest(F.col(f"g{j}") - F.col(p), F.lit(0.0)) + kinds)
        logs.append(F.log(p) + F.log(shares[j]) + F.when(F.col("declared") == "", F.lit(0.0)).otherwise(F.log(said)))
    rows = rows.withColumns({f"l{j}": x for j, x in enumerate(logs)})
    names = F.array(*map(F.lit, languages))
    every = F.array(*(F.col(f"l{j}") for j in range(len(ps))))
    best, text_best = F.array_max(every), F.array_max(F.array(*ps))
    return rows.select(
        "id", "address", "host", "suffix", "declared",
        F.element_at(names, F.array_position(every, best).cast("int")).alias("lang"),
        (1.0 / total([F.exp(F.col(f"l{j}") - best) for j in range(len(ps))])).alias("confidence"),
        F.element_at(names, F.array_position(F.array(*ps), text_best).cast("int")).alias("text_lang"), text_best.alias("text_confidence"),
    )


def identify_pages(pages: DataFrame, texts: Texts) -> DataFrame:
    """(page_id, url, host, suffix, declared, lang, confidence, text_lang, text_confidence) for each row of pages(page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("address"), F.col("html").cast("string").alias("text"))
    return fuse(common.keep(evidence(rows, texts, markup=True)), texts.languages).withColumnsRenamed({"id": "page_id", "address": "url"})


def identify_documents(docs: DataFrame, texts: Texts) -> DataFrame:
    """The same for docs(doc_id, text, source): nothing is declared, and the source stands for the address and host."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("address"), F.col("text").cast("string").alias("text"))
    return fuse(common.keep(evidence(rows, texts, markup=False)), texts.languages).withColumnsRenamed({"id": "doc_id", "address": "url"})
