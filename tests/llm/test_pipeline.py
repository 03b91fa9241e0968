import random

import pytest

import corpus_pipeline as C
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_near_dedup import brute as components
from tidewright.llm import mixing, quality


@pytest.fixture(scope="module")
def sf_dir(spark, words, tmp_path_factory):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(5)]
    texts = [prose(rng.randint(20, 90)) for _ in range(120)]
    for k in range(0, 120, 6):
        texts[k] = rng.choice([texts[k].upper().replace(" ", "!! "), (texts[k].split()[0] + " ") * 50])
    for k in range(1, 40, 5):
        own = texts[k].split()
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    texts += [texts[3], texts[9], texts[11] + " " + items[0][1], "Well, " + items[1][1] + ".", None, ""]
    docs = [(i, t, rng.choice(["en", None]), "s", len(t or "")) for i, t in enumerate(texts)]
    docs.append((None, prose(40), None, None, None))
    labels = [(i, int(i % 6 != 0), int(i % 7 == 0)) for i in range(0, 120)] + [(None, 1, 0), (5, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_equal_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("*", "'x' as shard", "1 as rate", "2 as gone")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    columns, dropped = docs.columns, {}
    for name, stage in C.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, sf_dir)
        if name == "quality":
            model = quality.learn(docs, labels)
            want = {r["doc_id"] for r in quality.score(docs, model).collect() if r["predicted"]}
        elif name == "near_dedup":
            want = {d for d, (_, _, kept) in components(before, 5).items() if kept}
        elif name == "decontamination":
            want = {d for d, _ in before} - {d for d, _ in leaks(before, items)}
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(docs, labels, kept=mixing.KEPT, ceiling=1.0).collect()}
            want = {d for d, n in copies.items() if n}
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(got) == want
        if name != "sharding":
            assert docs.columns == columns
        if name == "mixing":
            assert sorted(got) == sorted(d for d, n in copies.items() for _ in range(n))
            want = set(got)
        dropped[name] = len(before) - len(got)
    assert dropped["quality"] >= 18 and dropped["near_dedup"] >= 4 and dropped["decontamination"] == 2
    assert docs.groupBy("shard").count().count() == 16


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        if name != "near_dedup":
            assert stage(spark, docs, sf_dir).count() == 0


def test_run_is_the_stages_in_turn(spark, sf_dir):
    out = C.run(spark, sf_dir)
    assert out.columns[:4] == ["doc_id", "size", "text_crc32", "law"]
    assert out.count() > 60
    assert C.ORACLE_SQL is None and [n for n, _ in C.STAGES] == ["quality", "near_dedup", "decontamination", "mixing", "sharding"]
