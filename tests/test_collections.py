import json
import random

import pytest

from tracemill.sources import collections, readers

SCHEMA = "id string, tag string, g struct<type:string,coordinates:array<double>>"
NASTY = ["", "}", "{", "}{", '"', '\\"', "\\", "\\\\", '"features":[{', '],"features":[', "é}ü", "a}b\"c}", "\n}", "[[", "x" * 90, "features", "\U0001f600}"]


@pytest.fixture()
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def to(n):
        for name in names:
            spark.conf.set(name, str(n))

    yield to
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def collection(rng, n):
    """A collection with braces, quotes and the name `features` where they mislead."""
    def feature(k):
        f = {"id": str(k), "tag": rng.choice(NASTY), "g": {"type": "Point", "coordinates": [k / 2, 1.0]}, "extra": rng.choice([[], {}, [{"features": [{"id": "no"}]}], {"features": [{"id": "no"}]}, [[{}]]])}
        return dict(rng.sample(sorted(f.items(), key=lambda i: i[0]), len(f)))

    others = [("type", "FeatureCollection"), ("name", rng.choice(NASTY)), ("crs", {"features": [{"id": "no"}]}), ("list", [{"id": "no"}, "features", [{"id": "no"}]])]
    members = others + [("features", [feature(k) for k in range(n)])]
    rng.shuffle(members)
    return dict(members)


def plain(doc):
    return sorted((f["id"], f["tag"], f["g"]["coordinates"][0]) for f in doc["features"])


def got(spark, path, **settings):
    df = collections.features(spark, str(path), SCHEMA, **settings)
    return sorted(tuple(r) for r in df.select("feature.id", "feature.tag", "feature.g.coordinates").selectExpr("id", "tag", "coordinates[0]").collect())


@pytest.mark.parametrize("size, indent", [(17, None), (64, 1), (300, None), (100_000_000, 2)])
def test_splits_anywhere_give_the_features_of_a_plain_reader(spark, tmp_path, small_splits, size, indent):
    small_splits(size)
    docs = [collection(random.Random(seed), n) for seed, n in ((1, 12), (2, 0), (3, 9))]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=k == 0) + "\n" * k)
    assert got(spark, tmp_path) == sorted(r for doc in docs for r in plain(doc))


def test_states_without_a_broadcast_and_features_of_many_splits(spark, tmp_path, small_splits):
    small_splits(40)
    doc = collection(random.Random(5), 6)
    doc["features"][2]["tag"] = "}{" * 400  # one string across some twenty splits
    (tmp_path / "c.json").write_text(json.dumps(doc))
    assert collections.splits(spark, str(tmp_path)).select("block").distinct().count() > 20
    assert got(spark, tmp_path, broadcast_splits=0) == got(spark, tmp_path) == plain(doc)
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_empty_files_and_broken_features(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text('{"features": []}')
    (tmp_path / "c.json").write_text('[{"id": "no"}]')
    (tmp_path / "d.json").write_text('{"features": [{"user": "u", "timestamp": 5, "geomPoint.geom": {"type": "Point", "coordinates": [9.0, 45.0]}}, {"user": nonsense}, 7, null, [{"user": "v"}]]}')
    assert [tuple(r) for r in readers.geojson(spark, str(tmp_path)).collect()] == [("u", 5, 9.0, 45.0)]


def by_characters(text):
    """(quoted, open brackets) by a plain machine over every character; an array named `features` at the top is F."""
    quoted, escaped, stack, string, last = False, False, [], "", ""
    for c in text:
        if quoted:
            if not escaped and c == '"':
                quoted, last = False, string
            string, escaped = string + c, c == "\\" and not escaped
        elif c == '"':
            quoted, string = True, ""
        elif c in "{[":
            stack.append("O" if c == "{" else "F" if last == "features" and stack == ["O"] else "A")
            last = ""
        elif c in "}]":
            stack.pop()
            last = ""
    return quoted, "".join(stack)


def test_random_texts_by_every_cut():
    """The states put together from sums are those of a plain machine, wherever the text is cut at braces."""
    rng = random.Random(11)
    for seed in range(60):
        text = json.dumps(collection(random.Random(seed), 3), indent=rng.choice([None, 3]), ensure_ascii=False)
        ends = [k + 1 for k, c in enumerate(text) if c == "}"]
        cuts = [0, *sorted(rng.sample(ends[:-1], min(7, len(ends) - 1))), len(text)]
        sums, expected = [], []
        for a, b in zip(cuts, cuts[1:]):
            expected.append((a, *by_characters(text[:a])))
            for quoted in (False, True):
                s = collections.Scan(quoted)
                for part in (text[a : (m := text.index("}", a) + 1)], text[m:b]):
                    if part:
                        s.over(collections.Text(part.encode()))
                sums.append(("p", a, quoted, s.quoted, s.closed, "".join(s.stack)))
        frame = collections.pd.DataFrame(sums, columns=["path", "block", "quoted", "ends_quoted", "closed", "opened"])
        assert [tuple(r) for r in collections.folded(frame)[["block", "quoted", "open"]].itertuples(index=False)] == expected
