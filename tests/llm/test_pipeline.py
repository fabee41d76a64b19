import random

import brute
import corpus_pipeline
from test_operators import VOCAB, docs_df, edited, prose


def test_stages_on_planted_cases(spark, tmp_path):
    from tokenizers import Tokenizer

    from tallyweave.llm.queries import word_tokenizer

    rnd = random.Random(21)
    items = [(k, " ".join(f"z{rnd.randrange(900)}q" for _ in range(25)) + ". So it is " + " ".join(f"z{rnd.randrange(900)}q" for _ in range(4)) + ".") for k in range(10)]
    passage = prose(rnd, 55)
    docs, marks = [], []
    kinds: dict[str, set[int]] = {k: set() for k in ("clean", "toxic", "near", "leak", "passage")}
    for k in range(400):
        text = prose(rnd, rnd.randrange(30, 90))
        kind = "toxic" if k % 5 == 1 else "leak" if k % 40 == 2 else "passage" if k % 40 == 3 else "clean"
        if kind == "toxic":
            text = text.replace(" ", " vilescum ", 1)
        elif kind == "leak":
            text += " " + items[k % 10][1]
        elif kind == "passage":
            text += "\n" + passage
        kinds[kind].add(k)
        docs.append((k, text))
        marks.append((k, 1, int(kind == "toxic")))
    words = dict(docs)[0].split()
    docs.append((1000, dict(docs)[0]))
    docs.append((1001, "\n".join([" ".join(words[:-1] + [rnd.choice(VOCAB)])])))
    kinds["near"] |= {1000, 1001}
    base = f"file://{tmp_path}"
    docs_df(spark, docs).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"]
    at, ids, columns = spark.read.parquet(f"{base}/documents.parquet"), {}, docs_df(spark, docs).columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, base).write.parquet(f"{base}/out/{k}")
        at = spark.read.parquet(f"{base}/out/{k}")
        ids[name] = {r.doc_id for r in at.select("doc_id").collect()}
        if name != "bpe":
            assert at.columns == columns
    everything = {d for d, _ in docs}
    assert ids["toxicity"] == everything - kinds["toxic"]
    # the exact copy goes with its lines, the near one stays whole for the next stage
    assert ids["line_dedup"] == ids["toxicity"] - {1000}
    after = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/out/1").collect()}
    assert sum(passage in t for t in after.values()) == 1
    assert all(after[k] == dict(docs)[k] for k in kinds["clean"] & set(after)) and after[1001] == dict(docs)[1001]
    assert ids["near_dedup"] == {d for d, r in brute.near([(d, t) for d, t in after.items()], 5).items() if d == r}
    assert ids["decontamination"] == ids["near_dedup"] - kinds["leak"] and kinds["clean"] - kinds["near"] <= ids["decontamination"]
    tok = Tokenizer.from_file(word_tokenizer())
    for r in at.collect():
        want = tok.encode(after[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
    assert sorted(corpus_pipeline.run(spark, base).collect()) == sorted(at.collect())


def test_line_stage_holds_no_python(spark, tmp_path):
    rnd = random.Random(47)
    lines = [prose(rnd, 9) for _ in range(9)]
    docs = [(k, "\n".join(lines[k % 5 : k % 5 + 1 + k % 3])) for k in range(30)]
    out = corpus_pipeline.drop_lines(spark, spark.read.parquet(_written(spark, tmp_path, docs)), str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and out.count() < 30


def _written(spark, tmp_path, docs):
    docs_df(spark, docs).write.parquet(f"file://{tmp_path}/d")
    return f"file://{tmp_path}/d"


def test_near_dedup_stage_keeps_one_of_each_group(spark, tmp_path):
    rnd = random.Random(22)
    base = prose(rnd, 200)
    docs = [(k, edited(rnd, base, 0.004)) for k in range(20)] + [(100 + k, prose(rnd, 50)) for k in range(20)] + [(200, None), (201, "")]
    out = corpus_pipeline.drop_copies(spark, docs_df(spark, docs), str(tmp_path))
    want = {d for d, r in brute.near(docs, 5).items() if d == r}
    assert {r.doc_id for r in out.collect()} == want and out.columns == docs_df(spark, docs).columns


def test_line_stage_keeps_documents_that_no_other_holds(spark, tmp_path):
    rnd = random.Random(27)
    record = lambda k: f"order {k} of lot {k + 7} sent to customer {k * 3} by road"
    docs = [(k, record(k)) for k in range(5)] + [(10, prose(rnd, 9) + "\n" + record(90)), (11, record(91) + "\n" + record(92)), (12, record(0) + "\n")]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs_df(spark, docs), str(tmp_path)).collect()}
    want = {d: t for d, t in docs if d != 12}
    want[10] = want[10].split("\n")[0]
    assert out == want


CLASHES = "score predicted held_out owners raw_text n_lines n_dropped drop kept key node address sketch items line leaf blob findings __0 __kept __drop __text item_id".split()


def odd_rows():
    rnd = random.Random(41)
    rows = [(k, prose(rnd, rnd.randrange(20, 60)) + ("\nThe same line of eight words in every one" if k % 3 else "")) for k in range(60)]
    rows += [(60, None), (61, ""), (62, " \n\t "), (None, rows[4][1]), (None, None), (63, prose(rnd, 30_000)), (64, "one"), (7, rows[7][1]), (7, rows[7][1]), (65, rows[8][1])]
    return rows


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, and columns that bear the operators' names."""
    from pyspark.sql import functions as F

    base = f"file://{tmp_path}"
    rows = odd_rows()
    table = docs_df(spark, rows).select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
    table.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this stands in any text here. It does not.")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    at = spark.read.parquet(f"{base}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, base).write.parquet(f"{base}/out/{k}")
        at = spark.read.parquet(f"{base}/out/{k}")
        if name == "bpe":
            break
        got = at.collect()
        assert at.columns == table.columns, name
        for r in got:
            assert all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for c in CLASHES)
            if r.doc_id is not None and r.text != dict(rows)[r.doc_id]:
                assert name != "toxicity" and r.n_chars == len(r.text)
    ids = [r.doc_id for r in got]
    # the copy of 8 goes; rows that share an id stay together; rows without id or text stay
    want = [d for d, _ in rows if d != 65]
    assert sorted(ids, key=str) == sorted(want, key=str)
    texts = {r.doc_id: r.text for r in got}
    assert texts[60] is None and texts[61] == "" and texts[62] == " \n\t " and texts[63] == dict(rows)[63]
    assert sum("The same line" in (t or "") for d, t in texts.items() if d is not None) == 1
    encoded = {r.doc_id: r.n_tokens for r in at.collect()}
    assert encoded[60] == encoded[61] == 0 and encoded[63] > 30_000 and at.count() == len(want)


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    from tallyweave.session import scratch_root

    base = f"file://{tmp_path}"
    docs_df(spark, odd_rows()).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, "a test item. An answer.")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    from pathlib import Path

    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    out = corpus_pipeline.run(spark, base)
    assert [p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before] == ["pipeline-bpe"] and out.count() > 60


def test_empty_table(spark, tmp_path):
    base = f"file://{tmp_path}"
    none = docs_df(spark, [(1, "x")]).where("false")
    none.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0
