"""Every stage of the pipeline on what the one before kept, against plain Python."""

from collections import defaultdict

import corpus_pipeline
from tallyweave.session import stored

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def shingles(text):
    found = key(text).split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def test_stages(spark, data_dir):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, data_dir), "stage")
        kept.append(docs)
    good, lines, single, mixed, packed = ([r.asDict() for r in k.collect()] for k in kept)
    assert all(k.columns == kept[0].columns for k in kept[:4])
    ids = {r["doc_id"] for r in good}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in clean) >= 0.98 * len(clean)

    holders = defaultdict(set)
    for r in good:
        for line in r["text"].split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(r["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in lines}
    for r in good:
        left = [x for x in r["text"].split("\n") if len(holders[key(x)]) < 3 or max(holders[key(x)]) == r["doc_id"]]
        assert texts[r["doc_id"]] == "\n".join(left)

    stay, sets = {r["doc_id"] for r in single}, {i: shingles(t) for i, t in texts.items()}
    near = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    left = sorted(stay)
    assert not any(near(sets[a], sets[b]) for k, a in enumerate(left) for b in left[:k])
    assert all(any(near(sets[i], sets[j]) for j in sets if j < i) for i in sets if i not in stay)

    size = {r["doc_id"]: len(r["text"].split()) for r in single}
    taken = sum(len(r["text"].split()) for r in mixed)
    assert {r["doc_id"] for r in mixed} <= stay and abs(taken - 1.5 * sum(size.values())) < 0.05 * sum(size.values())
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed} and all(r["length"] <= 2048 for r in packed)


def test_stages_with_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Nulls in every column, repeated and missing ids, empty and very long texts, clashing names; and no rows at all."""
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    labels.coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for docs, rows in ((odd, 12), (empty, 0)):
        columns, before = docs.columns, rows
        for name, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)), "stage")
            if name != "packing":
                assert docs.columns == columns
            if name in ("quality classifier", "line dedup", "n-gram Jaccard join"):
                assert docs.count() <= before
                before = docs.count()
        assert (docs.count() > 0) == (rows > 0)
