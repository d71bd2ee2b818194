"""The pipeline against a plain version of every stage, each on its own input."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from promptscreen.llm import language, sharding
from promptscreen.llm.common import id_crc, table
from promptscreen.llm.mixing import MIX
from tests.conftest import SF001
from tests.llm import test_decontaminate, test_mixing_sharding, test_near

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    real = table(spark, SF001, "documents").withColumn("doc_id", F.col("doc_id") + 10_000)
    item = table(spark, SF001, "benchmark").filter("length(text) > 150").orderBy("item_id").first()
    dirty = spark.createDataFrame([(20_000, "Some text before. " + item["text"], "en", "src1", 1)], awkward.schema)
    awkward.unionByName(real.select(*COLUMNS)).unionByName(dirty).write.parquet(f"{path}/documents.parquet")
    table(spark, SF001, "benchmark").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_language(spark, docs):
    crf = language.fit(spark.createDataFrame(docs, docs[0].__fields__ and "doc_id long, text string, lang string, source string, n_chars long")
                       .filter(id_crc(F.col("doc_id")) % 4 != 2))
    found = [language.decode([d["text"]], crf)[0] for d in docs]                # one text at a time
    return [d for d, (lang, score, _) in zip(docs, found, strict=True) if lang != "und" and score >= language.MIN_SCORE]


def plain_near(docs):
    known = [d for d in docs if d["doc_id"] is not None]
    kept, seen = [], set()
    for d, (i, _, component) in zip(known, test_near.brute([(d["doc_id"], d["text"]) for d in known]), strict=True):
        if i == component and i not in seen:
            seen.add(i)
            kept.append(d)
    return kept + [d for d in docs if d["doc_id"] is None]


def plain_mix(docs):
    def leaf(d):
        s = d["source"] or ""
        n = s[len(s.rstrip("0123456789")):]
        return f"d{int(n) % 4}" if n else "", d["lang"] or "", s

    def weight(level, name):
        return MIX.weights[level].get(name, MIX.default_weight)

    size = [len((d["text"] or "").encode().split()) for d in docs]
    total = defaultdict(int)
    for d, n in zip(docs, size, strict=True):
        total[leaf(d)] += n
    total = {k: n for k, n in total.items() if n}
    budget = {(): sum(total.values()) * MIX.budget_num // MIX.budget_den}
    for level in range(3):
        families = defaultdict(dict)
        for k, n in total.items():
            old = families[k[:level]].get(k[level], (0, 0))[0]
            families[k[:level]][k[level]] = (old + n * MIX.max_epochs, weight(level, k[level]))
        budget = {(*p, name): b for p, kids in families.items() for name, b in test_mixing_sharding.brute_share(budget[p], kids).items()}
    out = []
    for k, n in total.items():
        mine = [(d, s) for d, s in zip(docs, size, strict=True) if leaf(d) == k and s]
        epoch = 0
        left = budget[k]
        while left >= n:
            out += [d["text"] for d, _ in mine]
            left -= n
            epoch += 1
        key = lambda x: (hashlib.md5(f"{MIX.seed}|{epoch}|{'' if x[0]['doc_id'] is None else x[0]['doc_id']}".encode()).hexdigest(), x[1])  # noqa: B023,E731
        for d, s in sorted(mine, key=key):
            if left <= 0:
                break
            out.append(d["text"] if s <= left else b" ".join(d["text"].encode().split()[:left]).decode())
            left -= s
    return out


def plain_shards(texts):
    size = defaultdict(int)
    for t in texts:
        size[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    order = sorted(size)
    sizes = [size[k] for k in order]
    capacity = sharding.smallest_capacity(sizes, sharding.SHARDS, max(sizes), sum(sizes))
    cuts = sharding.walk(sizes, capacity)
    shard, at = {}, 0
    for i, k in enumerate(order):
        at += i in cuts
        shard[k] = at
    return sorted((t or "", shard[hashlib.md5((t or "").encode()).hexdigest()]) for t in texts)


def test_stages(spark, folder):
    docs, rows = table(spark, folder, "documents"), None
    text = lambda rs: sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in rs))
    for name, stage in P.STAGES:
        before = docs.collect()
        docs = P.store(stage(spark, docs, folder), "stage")
        rows = docs.collect()
        if name == "language identification":
            assert text(rows) == text(plain_language(spark, before)) and 0 < len(before) - len(rows) < 12
        elif name == "near duplicates":
            assert text(rows) == text(plain_near(before))
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, folder, "benchmark").collect()]
            short = [d for d in before if len(d["text"]) < 3000]
            assert text(r for r in rows if len(r["text"]) < 3000) == text(d for d in short if not test_decontaminate.brute(d["text"], items)[4])
            assert 20_000 not in {r["doc_id"] for r in rows}
        elif name == "mixing to weights":
            assert sorted(r["text"] for r in rows) == sorted(plain_mix(before))
        else:
            assert sorted((r["text"] or "", r["shard"]) for r in rows) == plain_shards([d["text"] for d in before])
        if name != "sharding":
            assert docs.columns == COLUMNS
    assert len(P.STAGES) == 5 and rows[0].__fields__ == [*COLUMNS, "size", "text_crc32", "shard", "slot"]


def test_run_of_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_mixing_carries_columns_of_its_own_names(spark, awkward):
    names = ["mix_take", "Mix_Epoch", "_mfull", "_Mkey", "carried0"]
    got = P.mixed(spark, awkward.select("*", *(F.lit(n).alias(n) for n in names)), "")
    assert got.columns == [*COLUMNS, *names]
    rows = got.collect()
    assert rows and all(r[n] == n for r in rows for n in names)
    assert sorted(r["text"] for r in rows) == sorted(r["text"] for r in P.mixed(spark, awkward, "").collect())
