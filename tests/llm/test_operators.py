import random
import time
from collections import defaultdict

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import bpe, chat, components, decontam, linededup, minhash, pii, quality, secrets, toxicity, urlfilter
from tallyweave.llm.queries import QUERIES, word_tokenizer

SF = "/root/testdata/sf0.001"
VOCAB = [chr(97 + k // 20) + "o" + chr(97 + k % 20) + "a" for k in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_df(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)


def prose(rnd, n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def odd_texts(rnd, alphabet, n, longest=60):
    return [None, "", " \n\t", *["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(longest))) for _ in range(n)]]


# ---- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def test_bpe_equals_the_library(library):
    own = bpe.Bpe(bpe.load(word_tokenizer()))
    rnd = random.Random(1)
    alphabet = "aA'sS \t\n\x0b\x1c\x85 　éÉ́Σσς1²Ⅷ٣_-!?日本😀​\x00İıßſK #$" + "the"
    texts = odd_texts(rnd, alphabet, 3000)[1:] + ["x <|endoftext|> y<|startoftext|>z", "<|endoftext|", "ab" * 4000, "it's we'LL I'M", "a" * 200]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got.tolist() == want, t
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, library):
    import duckdb

    texts = dict(duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    for r in QUERIES["op2_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == brute.sha(" ".join(map(str, ids))) and r.decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False))
    out = bpe.encode_decode(docs_df(spark, [(1, None), (1, "a a"), (None, "a")]), word_tokenizer()).collect()
    assert sorted((r.doc_id or 0, len(r.ids)) for r in out) == [(0, 1), (1, 0), (1, 2)]


def test_bpe_on_odd_tables(spark, library):
    """An empty table, a very long text and word, repeated rows, null ids, columns that bear the results' names."""
    rnd = random.Random(42)
    long = prose(rnd, 50_000) + " " + "ab" * 30_000
    df = docs_df(spark, [(1, long), (None, "x"), (2, "y z"), (2, "y z")]).withColumns({"ids": F.lit("clash"), "decoded": F.lit(1)})
    out = sorted(bpe.encode_decode(df, word_tokenizer()).collect(), key=lambda r: (r.doc_id or 0))
    assert [r.doc_id for r in out] == [None, 1, 2, 2] and out[1].ids == library.encode(long, add_special_tokens=False).ids and out[2] == out[3]
    assert bpe.encode_decode(df.where("false"), word_tokenizer()).count() == 0


# ---- personal data and secrets


def test_pii_base_equals_plain_patterns(spark):
    rnd = random.Random(2)
    texts = odd_texts(rnd, "ab.@-+%_1234567890 4()\n٣é", 4000, 50) + ["+1 (980) 555-6268", "4111 1111 1111 1111", "4111-1111-1111-1111 2", "a@b.c@d.e.f", "1.2.3.4.5.6.7.8", "0255.1.1.1 999.1.1.1"]
    for t in texts:
        base = [(s, k, e) for s, k, e, _ in pii.find_pii(t) if k in pii.BASE]
        assert brute.labels(base, list(pii.BASE)) == brute.pii(t), t
    out = pii.detect(docs_df(spark, list(enumerate(texts[:300])))).collect()
    assert len(out) == 300 and not out[0].pii
    assert pii.detect(docs_df(spark, [(1, "x")]).where("false")).count() == 0


def test_pii_method_kinds_need_their_confirmation():
    kinds = lambda t: [k for _, k, _, _ in pii.find_pii(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"] and "iban" not in kinds("IBAN GB83 WEST 1234 5698 7654 32")
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    spans = lambda t: [(s, k, e) for s, k, e, _ in pii.find_pii(t)]
    # an upper-case word after it is no part of it; countries without a length have none
    assert spans("BE68 5390 0754 7034 IST") == [(0, "iban", 19)] == spans("BE68 5390 0754 7034 ist") and spans("BE68539007547034") == [(0, "iban", 16)]
    assert spans("BE68 5390 0754 7034X") == [] and kinds("QQ68 5390 0754 7034") == [] and spans("DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32") == [(0, "iban", 27), (28, "iban", 55)]
    assert kinds("Sozialversicherung 123-45-6789") == ["ssn"] == kinds("sécurité sociale: 123-45-6789")
    near, far = pii.find_pii("call phone +1 980 555 6268")[0], pii.find_pii("xxxx +1 980 555 6268")[0]
    assert near[3] > far[3]


def test_pii_query_equals_plain_patterns(spark):
    """Base kinds of every row of the query, and that all spans hold them."""
    docs = dict(small_documents())
    out = QUERIES["op3_pii"](spark, SF).collect()
    assert {r.doc_id for r in out} == set(docs)
    for r in out:
        base = brute.pii(docs[r.doc_id])
        assert r.base_sha256 == brute.sha(base) and set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert {k: r[f"n_{k}"] for k in pii.BASE} == {k: base.count(k + ":") for k in pii.BASE}
        for extra in set(filter(None, r.spans.split(","))) - set(base.split(",")):
            kind, start, end = extra.split(":")
            said = docs[r.doc_id][int(start) : int(end)]
            assert kind == "iban" and brute.iban(said) or kind == "ssn" and said.count("-") == 2
    odd = docs_df(spark, [(None, "a@b.co"), (1, None), (2, "x" * 200_000 + " a@b.co")]).withColumns({"pii": F.lit("clash"), "kind": F.lit(1)})
    assert {r.doc_id: len(r.pii) for r in pii.detect(odd).collect()} == {None: 1, 1: 0, 2: 1}


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "GB82" * 50_000])
def test_pii_is_linear(text):
    began = time.perf_counter()
    pii.find_pii(text)
    assert time.perf_counter() - began < 5


def test_secrets_equal_plain_patterns_and_ledger_is_incremental(spark, tmp_path):
    rnd = random.Random(3)
    parts = ["token", "Api_Key", "secret", "=", ":", " ", "'", '"', "abcdef0123456789", "AKIA", "ABCDEFGHIJKL", "-", "é😀", "\n", "x", "ToKeN=abc12345", "passwd"]
    texts = [None, "", *["".join(rnd.choice(parts) for _ in range(rnd.randrange(12))) for _ in range(500)], "token=token=abcdefgh", "token=secret:abcdefghij", "K=Key", "a" * 32 + "g" + "b" * 40]
    rows = docs_df(spark, list(enumerate(texts)) + [(9000, texts[5]), (9001, texts[5])])
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/ledger")
    found = ledger.scan(rows, "first")
    got = {r.doc_id: r for r in found.select("doc_id", secrets.spans_text(F.col("findings"), secrets.BASE_KINDS).alias("s"), "findings").collect()}
    assert len(got) == len(texts) + 2
    for k, t in enumerate(texts):
        assert got[k].s == brute.secrets(t), t
    assert got[9000].s == got[9001].s == got[5].s
    blobs = ledger.blobs().count()
    assert blobs == len({t or "" for t in texts})
    # a path with a new text, and one without change
    later = docs_df(spark, [(5, "fresh token=abcd12345678"), (6, texts[6]), (None, "token=abcd12345678")])
    again = ledger.scan(later, "second").collect()
    assert ledger.blobs().count() == blobs + 2 and [len(r.findings) for r in again if r.doc_id in (5, None)] == [1, 1]
    history = {(r.doc_id, r.seen): len(r.findings) for r in ledger.findings().collect() if r.doc_id in (5, 6, None)}
    assert set(history) == {(5, "first"), (5, "second"), (6, "first"), (None, "second")} and history[5, "second"] == 1
    ledger.scan(rows, "rules", version="next")
    assert ledger.blobs().count() == blobs + 2 + blobs and ledger.blobs("next").count() == blobs
    # what a failed scan wrote twice counts once
    ledger.blobs("next").write.parquet(f"file://{tmp_path}/copy")
    spark.read.parquet(f"file://{tmp_path}/copy").write.mode("append").parquet(f"file://{tmp_path}/ledger/blobs")
    assert ledger.scan(rows, "rules", version="next").count() == len(texts) + 2
    empty = secrets.Ledger(spark, f"file://{tmp_path}/empty")
    assert empty.blobs() is None and empty.scan(rows.where("false"), "x").count() == 0
    long = "x " * 400_000 + "token=abcd12345678 " + "a" * 300_000
    extra = empty.scan(docs_df(spark, [(1, "-----BEGIN RSA PRIVATE KEY-----"), (2, long)]).withColumns({"blob": F.lit(1), "seen": F.lit(2)}), "y").orderBy("doc_id").collect()
    assert [[f.kind for f in r.findings] for r in extra] == [["pem"], ["assign", "hex"]]
    assert secrets.spans_text(F.lit(None)) is not None and brute.secrets(long) == f"assign:800000:800018,hex:{800019}:{1100019}"


@pytest.mark.parametrize("bits", [1 << 29, 8])
def test_second_scan_reads_only_what_is_new(spark, tmp_path, monkeypatch, bits):
    """Also where the bitmap of known blobs is so full that it lets all pass."""
    from tallyweave.llm import common

    monkeypatch.setattr(common, "MOST_BITS", bits)
    monkeypatch.setattr(common, "LEAST_BITS", bits)
    seen = []
    plain = secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda blobs, rules: (seen.append(blobs.count()), plain(blobs, rules))[1])
    ledger = secrets.Ledger(spark, f"file://{tmp_path}/l")
    docs = docs_df(spark, [(k, f"text {k // 2}") for k in range(20)])
    ledger.scan(docs.where("doc_id < 10"), "a")
    ledger.scan(docs, "b")
    assert seen == [5, 5]


# ---- chat


def test_chat_round_trip_windows_and_masks(spark):
    rnd = random.Random(4)
    bits = ["<|turn|>", "<|end|>", "<|", "\\", "|", "<", "\n", "</s>[INST]", "hello ", "word " * 30, "é😀", "\\n", "\\|", "<\\|"]
    rows = []
    for c in range(40):
        for t in range(rnd.randrange(1, 25)):
            role = "system" if t == 0 and c % 2 else rnd.choice(("user", "assistant", "tool\n\\n", None))
            rows.append((c, rnd.choice((t, t, None)), role, rnd.choice((None, "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))))))
    rows += [(100, 1, "assistant", "x" * 5000), (100, 1, "assistant", "x" * 5000), (None, 0, "user", "hi")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=200, history=60).withColumns({"turns": chat.read_turns(F.col("formatted")), "learned": chat.read_loss(F.col("formatted"), F.col("loss"))}).collect()
    by = defaultdict(list)
    for w in windows:
        by[w.conv_id].append(w)
    source = defaultdict(list)
    for c, *r in rows:
        source[c].append(r)
    assert set(by) == set(source)
    for c, ws in by.items():
        ws.sort(key=lambda w: w.window)
        assert [w.window for w in ws] == list(range(len(ws)))
        turns = [t for w in ws for t in w.turns]
        learned = "".join(w.learned for w in ws)
        said = brute.sha("".join(f"{t.role}\n{t.text}\n" for t in turns))
        assert (len(turns), said, len(learned), brute.sha(learned)) == brute.conversation(source[c])
        for w in ws:
            if w.tokens > 200:
                assert len(w.turns) == 1
            system = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in source[c]))[0]
            if system[2] == "system" and w.window:
                assert w.formatted.startswith("<|seen|>system\n")
    assert any("<|seen|>" in w.formatted for w in windows)
    assert chat.format_windows(df.where("false")).count() == 0


def test_chat_on_odd_rows(spark):
    """Very long turns, rows without conv_id, token counts from a column, columns that bear the operator's names."""
    rows = [(1, 0, "user", "word " * 100_000, 3), (1, 1, "assistant", "ok " * 50_000, 4), (None, 0, "user", "a", 1), (None, 0, "user", "b", 1), (None, 0, "user", "b", 1), (2, 0, "system", "s", 5)]
    rows += [(2, k, "assistant", f"t{k}", 10) for k in range(1, 30)] + [(3, 0, None, None, None), (3, 1, "assistant", "x", -4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n long")
    df = df.withColumns({c: F.lit("clash") for c in ("part", "window", "pos", "tokens", "formatted", "loss", "cell", "first", "begin", "end")})
    out = chat.format_windows(df, budget=60, history=20, tokens_col="n").withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    by = defaultdict(list)
    for r in out:
        by[r.conv_id, r.part].append(r)
    assert [len(r.turns) for r in by[1, None]] == [2] and len(by[1, None][0].formatted) > 600_000
    assert sorted(len(rs[0].turns) for (c, _), rs in by.items() if c is None) == [1, 2] and [r.tokens for r in by[3, None]] == [0]
    assert sum(len(r.turns) for r in by[2, None]) == 30 and max(r.tokens for r in by[2, None]) <= 60 and len(by[2, None]) > 5
    assert chat.format_windows(df, budget=60, history=20, estimate=F.length).where("conv_id = 1").count() == 2


def test_chat_query_equals_plain_reading(spark):
    import duckdb

    source = defaultdict(list)
    for c, *r in duckdb.connect().execute(f"select conv_id, turn, role, text from '{SF}/conversations.parquet'").fetchall():
        source[c].append(r)
    source[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op5_chat"](spark, SF).collect()}
    assert got == {c: brute.conversation(r) for c, r in source.items()}


# ---- quality


def test_quality_base_equals_plain_counts_and_verdicts(spark):
    rnd = random.Random(5)
    texts = odd_texts(rnd, "ab #*|\n\t\x0b é", 150, 200)
    for _ in range(60):
        words = [rnd.choice("abcde") for _ in range(rnd.randrange(5, 60))]
        texts.append(" ".join(words + words[: rnd.randrange(len(words))]))
    plain = "the of and to in a is that for it was with be by on not he are this at from or an have running water stone house garden river light paper"
    texts += [" ".join(rnd.choice(plain.split()) for _ in range(300)) for _ in range(40)] + [" ".join(rnd.choice(["$$$###", "0000", "@@!!"]) + str(rnd.random()) for _ in range(200))]
    out = {r.doc_id: r for r in quality.score_quality(docs_df(spark, list(enumerate(texts))).withColumn("n_words", F.lit("clash"))).collect()}
    for k, t in enumerate(texts):
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), t
        assert not (r.kept and r.base_failed)
    assert not out[len(texts) - 1].kept and not out[len(texts) - 1].base_failed
    assert sum(out[k].kept for k in range(len(texts) - 41, len(texts) - 1)) == 40
    other = quality.score_quality(docs_df(spark, [(1, texts[-1])]).withColumn("lang", F.lit(None).cast("string"))).first()
    assert other.kept and other.char_distance is None
    assert quality.score_quality(docs_df(spark, []).where("false")).count() == 0


def test_quality_on_odd_rows(spark):
    """Repeated rows, a very long text, values at the very limits."""
    rnd = random.Random(43)
    at_limit = lambda n: " ".join(f"w{k}" for k in range(n))
    half = [f"a{k}" for k in range(8)]
    thirty = " ".join(half + [f"u{k}" for k in range(37)] + half)  # 16 of 53 words: 30.2 %
    below = " ".join(half + [f"u{k}" for k in range(38)] + half)  # 16 of 54: 29.6 %
    texts = [at_limit(19), at_limit(20), thirty, below, prose(rnd, 60_000), prose(rnd, 60_000) + " x" * 60_000]
    df = docs_df(spark, [*enumerate(texts), (3, below), (None, below)])
    out = defaultdict(list)
    for r in quality.score_quality(df).collect():
        out[r.doc_id].append(r)
    for k, t in enumerate(texts):
        for r in out[k]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t)
    assert [out[k][0].base_failed for k in range(4)] == [True, False, True, False] and len(out[3]) == 2 and out[3][0] == out[3][1] and len(out[None]) == 1


# ---- URL filters


def test_url_filter_equals_plain_lookup(spark):
    rnd = random.Random(6)
    domains = ["a.com", "x.a.com", "b.org", "y.x.a.com", "com", "10.1.2.3", "2.3", "[2001:db8::1]", "ss"]
    hosts = ["a.com", "X.a.com.", "z.y.x.a.com", "b.org", "other.net", "com", "10.1.2.3", "110.1.2.3", "[2001:DB8::1]", "a" * 300 + ".a.com"]
    users = ["", "u@", "u:p@", "user:p@ss@", "b.org@", "@"]
    entries = [(rnd.choice("pq"), rnd.choice(domains), rnd.randrange(20), rnd.choice(("add", "remove"))) for _ in range(90)]
    captures = [(k, f"https://{rnd.choice(users)}{rnd.choice(hosts)}{rnd.choice(('', ':80', ':'))}{rnd.choice(('', '/p?q@b.org#f', '?x@b.org', '#b.org', chr(92) + '@b.org'))}", rnd.randrange(22)) for k in range(600)]
    odd = [None, "no url", "http://", "http:///x", "http://[::1", "://a.com", "1a://a.com", " HTTP://A.com ", "http://a.com]/", "http://a..com./", "http://a.com/" + "x@" * 100_000, "http://" + "a." * 5000 + "a.com/"]
    captures += [(900 + k, u, 3) for k, u in enumerate(odd)] + [(990, "http://a.com/", None), (0, captures[0][1], captures[0][2])]
    cap = spark.createDataFrame(captures, "page_id long, url string, fetched_at int").withColumns({"list": F.lit("clash"), "domain": F.lit("x"), "__host": F.lit("y")})
    ent = spark.createDataFrame([*entries, (None, "a.com", 0, "add"), ("p", None, 0, "add"), *entries[:5]], "list string, domain string, at int, action string")
    out = urlfilter.evaluate(cap, ent).collect()
    assert len(out) == len(captures)
    for r in out:
        assert r.host == brute.url_host(r.url), r
        want = brute.url_verdict(r.host, r.fetched_at, entries) if r.host and r.fetched_at is not None else None
        assert (r.list, r.blocked) == (want, want is not None), r
    assert len({r.list for r in out}) == 3
    assert urlfilter.evaluate(cap, ent.where("false")).where("blocked").isEmpty()
    assert urlfilter.evaluate(cap.where("false"), ent).count() == 0


def test_hosts_are_those_that_browsers_reach(spark):
    cases = {"http://user:p@ss@Evil.com/": "evil.com", "http://[2001:db8::1]/x": "[2001:db8::1]", "http://10.1.2.3:8080/": "10.1.2.3", "http://good.org\\@evil.com/": "good.org", "http://evil.com?@good.org": "evil.com"}
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", urlfilter.host_of(F.col("url")).alias("h"))
    assert {r.url: r.h for r in df.collect()} == cases
    ent = spark.createDataFrame([("l", "com", 0, "add"), ("l", "2.3", 0, "add")], "list string, domain string, at int, action string")
    out = urlfilter.evaluate(df.select("url", F.lit(1).alias("fetched_at")), ent).collect()
    assert {r.host for r in out if r.blocked} == {"evil.com"}


# ---- decontamination


def test_wand_equals_exhaustive_scores():
    rnd = random.Random(7)
    items = [(k, prose(rnd, rnd.randrange(4, 60))) for k in range(300)]
    index = decontam.Index(items)
    for _ in range(60):
        query = set(prose(rnd, 80).split()) | set(rnd.choice(items)[1].split()[: rnd.randrange(30)])
        scores = defaultdict(float)
        for t in query:
            for block, _, _ in index.blocks.get(t, []):
                for unit, x in block:
                    scores[unit] += x
        for threshold in (0.05, 0.15, 0.4, 0.8):
            assert {u for u, _ in index.search(query, threshold)} == {u for u, x in scores.items() if x >= threshold - 1e-9}


def test_leaks_are_found_wherever_they_lie(spark):
    rnd = random.Random(8)
    own = [f"q{k}" for k in range(500)]
    items = [(k, " ".join(rnd.choice(own) for _ in range(rnd.randrange(12, 70))) + ". The answer is " + " ".join(rnd.choice(own) for _ in range(5)) + ".") for k in range(60)]
    docs, want = [], set()
    for d in range(150):
        text = prose(rnd, rnd.randrange(0, 900)).split()
        if d % 3 == 0:
            k = rnd.randrange(60)
            at = rnd.randrange(len(text) + 1)
            text[at:at] = items[k][1].upper().split() if d % 2 else items[k][1].split()
            want.add((d, k))
        docs.append((d, " ".join(text)))
    docs += [(900, None), (901, " "), (902, items[3][1]), (902, items[3][1]), (None, items[4][1])]
    want |= {(902, 3), (None, 4)}
    table = spark.createDataFrame([*items, (None, "x y"), (77, None), (78, " ")], "item_id long, text string")
    df = docs_df(spark, docs)
    out = decontam.find_leaks(df, table).collect()
    assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want) + 1
    kept = decontam.without_leaks(df, table)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.find_leaks(df, table.where("false")).count() == 0 and decontam.without_leaks(df, table.where("false")).count() == len(docs)


def test_long_items_need_their_whole_answer(spark):
    rnd = random.Random(28)
    own = lambda n: " ".join(f"l{rnd.randrange(5000)}g" for _ in range(n))
    answer = "So it is " + own(12) + "."
    question = own(138)
    item = f"{question}. {answer}"
    words = item.split()
    docs = [
        (0, prose(rnd, 300) + " " + item),
        (1, question),  # no answer
        (2, prose(rnd, 200) + " " + " ".join(words[-128:])),  # the tail with the answer
        (3, question + ". " + prose(rnd, 700) + " " + answer),  # the answer elsewhere
        (4, answer),
    ]
    table = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {r.doc_id for r in decontam.find_leaks(docs_df(spark, docs), table).collect()} == {0, 2, 3}
    assert {r.doc_id for r in decontam.without_leaks(docs_df(spark, docs), table).collect()} == {1, 4}


def test_scores_do_not_depend_on_index_blocks(spark, monkeypatch):
    rnd = random.Random(29)
    items = [(k, prose(rnd, rnd.randrange(20, 200))) for k in range(30)]
    docs = docs_df(spark, [(k, " ".join(t.split()[: int(len(t.split()) * rnd.uniform(0.5, 1))])) for k, t in items])
    table = spark.createDataFrame([*items, (40, None), (41, " ")], "item_id long, text string")
    hits = lambda: {(r.doc_id, r.item_id): (r.n_passages, round(r.score, 9)) for r in decontam.find_leaks(docs, table).collect()}
    want = hits()
    monkeypatch.setattr(decontam, "INDEX_CHARS", 1500)
    assert want and hits() == want


def test_decontamination_query_equals_plain_scores(spark):
    import duckdb

    items = duckdb.connect().execute(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = brute.leaks(small_documents(), items)
    got = {(r.doc_id, r.item_id): (r.n_passages, r.score, r.question_overlap, r.answer_overlap) for r in QUERIES["op6_decontam"](spark, SF).collect()}
    assert want and set(got) == set(want)
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)


def test_decontamination_equals_plain_scores_on_near_misses(spark, monkeypatch):
    """Items in part, out of order, with another answer, in very long and repeated texts; items that share an id; several index blocks."""
    rnd = random.Random(34)
    own = lambda n: " ".join(f"y{rnd.randrange(150)}k" for _ in range(n))
    items = [(k, own(rnd.randrange(6, 40)) + ". It is " + own(4) + ".") for k in range(40)]
    docs = []
    for k in range(160):
        words = rnd.choice(items)[1].split()
        cut = words[: int(len(words) * rnd.uniform(0.4, 1))]
        if k % 4 == 1:
            rnd.shuffle(cut)
        docs.append((k, prose(rnd, rnd.randrange(80)) + " " + " ".join(w if rnd.random() > 0.04 else "other" for w in cut) + " " + prose(rnd, 9)))
    docs += [(500, prose(rnd, 30_000) + " " + items[7][1] + " " + prose(rnd, 30_000)), (501, None), (502, items[3][1] * 3)]
    df = docs_df(spark, docs).withColumns({"item_id": F.lit("clash"), "score": F.lit(None)})
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks(docs, items)
    found = lambda: {(r.doc_id, r.item_id): (r.n_passages, r.score, r.question_overlap, r.answer_overlap) for r in decontam.find_leaks(df, table).collect()}
    got = found()
    assert len(want) > 15 and set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    monkeypatch.setattr(decontam, "INDEX_CHARS", 1500)
    assert set(found()) == set(want)
    kept = decontam.without_leaks(df, table)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    shared = spark.createDataFrame([*items, *((k, prose(rnd, 30)) for k in range(40))], "item_id long, text string")
    assert set(want) <= {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, shared).collect()}
    assert decontam.find_leaks(df, shared).groupBy("doc_id", "item_id").count().where("count > 1").isEmpty()


def test_decontamination_query_finds_verbatim_items(spark):
    import duckdb

    con = duckdb.connect()
    want = set(con.execute(f"select doc_id, item_id from '{SF}/documents.parquet' d, '{SF}/benchmark.parquet' b where contains(d.text, b.text)").fetchall())
    assert want <= {(r.doc_id, r.item_id) for r in QUERIES["op6_decontam"](spark, SF).collect()}


# ---- toxicity


def toxic_corpus(rnd, n):
    rows, marks = [], []
    for k in range(n):
        bad = rnd.random() < 0.2
        words = prose(rnd, rnd.randrange(5, 60)).split()
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(("vile!", "rotten", "Vilest"))
        # the group is named more often in toxic rows, which a plain model would learn
        if rnd.random() < (0.7 if bad else 0.1):
            words.append("muslim")
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    return rows, marks


def test_toxicity_learns_and_ignores_identity(spark):
    rnd = random.Random(9)
    rows, marks = toxic_corpus(rnd, 600)
    docs = docs_df(spark, [*rows, (5000, None), (5000, None)])
    marked = spark.createDataFrame([*marks, (None, 1, 1), (7000, 1, None)], "doc_id long, quality int, toxic int")
    fair = toxicity.fit(docs, marked, counterfactual=50.0)
    plain = toxicity.fit(docs, marked, counterfactual=0.0)
    logit = lambda p: np.log(p / (1 - p))
    gap = lambda m: abs(logit(m.score("a muslim neighbour")) - logit(m.score("a jewish neighbour")))
    assert gap(fair) < 0.3 * gap(plain)
    out = toxicity.score(docs, fair, keep=("lang", "score")).collect()
    assert len(out) == 602 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    truth = {d: t for d, _, t in marks}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert abs(out[0].score - fair.score(rows[out[0].doc_id][1])) < 1e-9
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    none = toxicity.fit(docs, marked.where("false"))
    assert none.weights == {} and none.score("x") == 0.5


def test_toxicity_query_finds_held_out_toxic_documents(spark):
    """Over all documents, against the labels that were held out."""
    sf = "/root/testdata/sf0.01"
    import duckdb

    truth = dict(duckdb.connect().execute(f"select doc_id, max(toxic) from '{sf}/labels.parquet' group by 1").fetchall())
    ids = {d for (d,) in duckdb.connect().execute(f"select doc_id from '{sf}/documents.parquet'").fetchall()}
    out = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    assert set(out) == ids
    held = [r for d, r in out.items() if r.held_out and d in truth]
    toxic, clean = [r for r in held if truth[r.doc_id]], [r for r in held if not truth[r.doc_id]]
    assert toxic and sum(r.predicted for r in toxic) >= 0.6 * len(toxic) and sum(r.predicted for r in clean) <= 0.05 * len(clean)


def test_toxicity_on_odd_tables(spark):
    rows, marks = toxic_corpus(random.Random(44), 300)
    kind = "doc_id long, quality int, toxic int"
    model = toxicity.fit(docs_df(spark, rows), spark.createDataFrame(marks, kind), max_features=50)
    assert 0 < len(model.weights) <= 50 + len(toxicity.SWAP)
    long = prose(random.Random(45), 60_000)
    df = docs_df(spark, [(1, long + " vile!"), (2, long), (None, "x")]).withColumns({"score": F.lit("clash"), "__text": F.lit(1)})
    out = {r.doc_id: r for r in toxicity.score(df, model, keep=("__text",)).collect()}
    assert out[1].score > out[2].score and not out[None].held_out and out[2]["__text"] == 1
    assert toxicity.score(df.where("false"), model).count() == 0
    none = toxicity.fit(df.where("false"), spark.createDataFrame([], kind))
    assert none.score("vile") == 0.5


def test_toxicity_never_reads_held_out_labels(spark):
    rows, marks = toxic_corpus(random.Random(10), 200)
    docs = docs_df(spark, rows)
    import zlib

    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 5 == 0 else t) for d, q, t in marks]
    kind = "doc_id long, quality int, toxic int"
    a, b = toxicity.fit(docs, spark.createDataFrame(marks, kind)), toxicity.fit(docs, spark.createDataFrame(flipped, kind))
    assert a.weights == b.weights and a.bias == b.bias


# ---- components and near duplicates


def test_components_equal_union_find(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 700)] + [(5, 5), (None, 3)]
    out = components.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    good = [(a, b) for a, b in pairs if a is not None and a != b]
    want = brute.components(good, {x for p in good for x in p})
    assert {r.node: r.root for r in out.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(rnd, text, share):
    return " ".join(rnd.choice(VOCAB) if rnd.random() < share else w for w in text.split())


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, words):
    rnd = random.Random(12)
    docs, k = [], 0
    for _ in range(25):
        base = prose(rnd, rnd.randrange(20, 150))
        for _ in range(rnd.randrange(1, 8)):
            docs.append((k, edited(rnd, base, rnd.choice((0, 0.01, 0.03, 0.06)))))
            k += 1
    docs += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "ône"), (1005, "Ône"), (1006, docs[0][1].upper()), (3, docs[3][1]), (7, prose(rnd, 40))]
    df = docs_df(spark, docs).withColumn("kept", F.lit(1))
    out = minhash.near_duplicates(df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), words=words).collect()
    want = brute.near(docs, words)
    assert len(out) == len(docs) + 1
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    sizes = {d: len(brute.shingle_set(t, words)) for d, t in docs if d != 7}
    assert all(r.n_shingles == sizes[r.doc_id] for r in out if r.doc_id in sizes)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def near_equal_all_pairs(spark, docs, words=2):
    out = minhash.near_duplicates(docs_df(spark, docs), words=words).collect()
    want = brute.near(docs, words)
    assert not [r.doc_id for r in out if r.component_id != want[r.doc_id]]
    return want


@pytest.mark.parametrize("cell", [8192, 5])
def test_large_groups_cross_blocks(spark, monkeypatch, cell):
    """Small limits force every path: branching, anchors, blocks, rare shingles in cells."""
    for name, value in {"SMALL": 8, "LARGE": 48, "LAST": 32, "FEW": 4, "ANCHORS": 4, "BLOCK_DOCS": 10, "CELL_DOCS": cell}.items():
        monkeypatch.setattr(minhash, name, value)
    rnd = random.Random(13)
    base = prose(rnd, 120)
    near_equal_all_pairs(spark, [(k, edited(rnd, base, 0.03)) for k in range(150)] + [(1000 + k, prose(rnd, 60)) for k in range(100)])


@pytest.mark.parametrize("share", [0.06, 0.1, 0.14])
def test_pairs_in_a_large_family_cross_last_blocks(spark, monkeypatch, share):
    """Texts that share a core but are mostly below the similarity: the nodes of the last level are over-full."""
    for name, value in {"LEVELS": 1, "SMALL": 8, "LARGE": 48, "LAST": 8, "FEW": 2, "ANCHORS": 2, "BLOCK_DOCS": 20, "CELL_DOCS": 16}.items():
        monkeypatch.setattr(minhash, name, value)
    rnd = random.Random(23)
    core = prose(rnd, 120)
    docs = []
    for k in range(150):
        own = edited(rnd, core, share)
        docs += [(k, own), (1000 + k, own + " " + prose(rnd, 3))]
    assert len(set(near_equal_all_pairs(spark, docs).values())) > 20


def test_a_family_below_the_similarity_makes_no_pairs(spark, monkeypatch):
    """Pages of one template, each with its own part, at 0.68 to 0.76 of each other: what they share is no key."""
    for name, value in {"LEVELS": 1, "SMALL": 8, "LAST": 8, "FEW": 2, "ANCHORS": 2, "BLOCK_DOCS": 20}.items():
        monkeypatch.setattr(minhash, name, value)
    rnd = random.Random(35)
    core = prose(rnd, 170)
    docs = [(k, core + " " + " ".join(f"p{k}x{j}" for j in range(rnd.randrange(24, 34)))) for k in range(300)]
    docs += [(500 + k, docs[7 * k][1] + f" tail{k}") for k in range(20)]
    seen = []
    plain = minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, name, keep=False: (lambda t: (seen.append((name, t[0].count())), t)[1])(plain(df, name, keep)))
    assert len(set(near_equal_all_pairs(spark, docs).values())) == 300
    assert dict(seen)["pairs"] <= 60


def test_prefixes_of_similar_sets_share_a_shingle():
    rnd = random.Random(36)
    for _ in range(3000):
        n = rnd.randrange(1, 60)
        x = set(rnd.sample(range(90), n))
        y = {e for e in x if rnd.random() > 0.08} | set(rnd.sample(range(90), rnd.randrange(5)))
        small, large = sorted((x, y), key=len)
        if small and 100 * len(x & y) >= 80 * len(x | y):
            few, many = minhash.prefix_lengths(len(small), 80)[0], minhash.prefix_lengths(len(large), 80)[1]
            assert set(sorted(small)[:few]) & set(sorted(large)[:many])


def test_a_very_long_text_and_a_copy(spark):
    rnd = random.Random(37)
    long = prose(rnd, 40_000)
    near_equal_all_pairs(spark, [(1, long), (2, edited(rnd, long, 0.02)), (3, prose(rnd, 40_000)), (4, "a " * 50_000), (5, "a " * 9)], words=5)


def test_near_duplicate_query_on_the_small_tables(spark):
    import duckdb

    docs = duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    assert {r.doc_id: r.component_id for r in QUERIES["op10_minhash"](spark, SF).collect()} == brute.near(docs, 2)


@pytest.mark.parametrize("bits", [1 << 29, 1 << 16])
def test_bitmaps_lose_no_key(spark, monkeypatch, bits):
    from tallyweave.llm import common

    monkeypatch.setattr(common, "MOST_BITS", bits)
    rnd = random.Random(46)
    keys = {rnd.randrange(10**12) for _ in range(3000)}
    rows = [*keys, *(rnd.randrange(10**12) for _ in range(9000)), None]
    df = spark.createDataFrame([(k,) for k in rows], "k long").withColumns({"__bits": F.lit(1), "__bucket": F.lit(2)})
    hit, other = common.split_by_bitmap(df, common.bitmap_of(spark.createDataFrame([(k,) for k in keys], "k long"), "k"), F.col("k"))
    found, rest = [r.k for r in hit.collect()], [r.k for r in other.collect()]
    assert keys <= set(found) and not keys & set(rest) and None in rest and len(found) + len(rest) == len(rows) and hit.columns == df.columns
    assert len(found) < (3700 if bits > 1 << 16 else 6000)


# ---- line dedup


def test_line_dedup(spark):
    rnd = random.Random(14)
    licence = "Licensed under the Apache License, Version 2.0."
    passage = prose(rnd, 60)
    log = lambda k: f"error at node {k} after {k * 7} retries while reading the shared block map"
    varied = lambda: " ".join(w if rnd.random() > 0.1 else rnd.choice(VOCAB) for w in passage.split())
    docs = []
    for k in range(30):
        lines = [prose(rnd, 12), licence, prose(rnd, 9)] + ([passage] if k % 5 == 0 else []) + ([log(k)] if k % 4 == 1 else []) + ["Of it."]
        docs.append((k, "\n".join(lines)))
    docs += [(40, None), (41, ""), (42, "\n\n x \r"), (43, docs[0][1]), (44, prose(rnd, 30) + "\n" + passage.split()[0] + " " + " ".join(varied().split()[1:])), (None, licence)]
    df = docs_df(spark, docs).withColumn("n_lines", F.lit("clash"))
    out = {r.doc_id: r for r in linededup.drop_recurring_lines(df, short_count=100).collect()}
    assert len(out) == len(docs)
    owners = {"licence": 0, "passage": 0, "log": 1}
    for k, t in docs[:30]:
        want = [x for x in t.split("\n") if not (x == licence and k != owners["licence"] or x == passage and k != owners["passage"] or x.startswith("error") and k != owners["log"])]
        assert out[k].text == "\n".join(want) and out[k].n_dropped == len(t.split("\n")) - len(want) and out[k].n_lines == len(t.split("\n"))
    assert out[40].text is None and out[40].n_lines == 0 and out[41].text == "" and out[42].text == "\n\n x \r"
    assert out[43].text == "Of it." and out[None].text == licence
    assert linededup.drop_recurring_lines(df.where("false")).count() == 0


def test_line_dedup_groups_equal_a_plain_tree(spark):
    """Exact recurrence over random lines, against a count in plain Python (no two lines agree enough to merge)."""
    rnd = random.Random(15)
    pool = [prose(rnd, rnd.randrange(6, 40)) for _ in range(60)]
    docs = [(k, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 10)))) for k in range(50)]
    owner = {}
    for k, t in docs:
        for x in t.split("\n"):
            owner.setdefault(x, k)
    shared = {x for x in pool if len({k for k, t in docs if x in t.split("\n")}) > 1}
    for r in linededup.drop_recurring_lines(docs_df(spark, docs)).collect():
        want = [x for x in docs[r.doc_id][1].split("\n") if x not in shared or owner[x] == r.doc_id]
        assert r.text == "\n".join(want)


def small_documents():
    import duckdb

    return duckdb.connect().execute(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def test_line_dedup_query_equals_a_plain_template_tree(spark):
    want = brute.line_templates(small_documents())
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in QUERIES["op1_linededup"](spark, SF).collect()}
    assert got == want and sum(n for *_, n in want.values()) > 50


def test_line_dedup_equals_a_plain_tree_on_hot_leaves(spark, monkeypatch):
    """Leaves of many templates, lines that tie, long lines, in small parts and rounds."""
    for name, value in {"CANDIDATES": 2, "MOST_CANDIDATES": 5, "PART_LINES": 7}.items():
        monkeypatch.setattr(linededup, name, value)
    rnd = random.Random(31)
    bodies = [f"svc {rnd.randrange(9)} says " + prose(rnd, rnd.choice((8, 8, 300))) for _ in range(25)]
    docs = [(k, "\n".join(edited(rnd, rnd.choice(bodies), rnd.choice((0, 0.1, 0.3, 0.5))) for _ in range(rnd.randrange(1, 12)))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "a b c\n" * 4), (103, prose(rnd, 30_000))]
    out = linededup.drop_recurring_lines(docs_df(spark, docs).withColumns({"leaf": F.lit(1), "owners": F.lit(2), "__drop": F.lit(3)}).repartition(7)).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out} == brute.line_templates(docs)


def test_every_template_of_a_leaf_is_dropped(spark):
    """Twelve templates of one length and start, each in ten documents: all but the first copies go."""
    rnd = random.Random(32)
    heads = [prose(rnd, 9) for _ in range(12)]
    docs = [(k, f"INFO svc worker {heads[k % 12]} took {k} ms") for k in range(120)]
    out = linededup.drop_recurring_lines(docs_df(spark, docs)).collect()
    assert sum(r.n_dropped for r in out) == 108


def test_lines_that_share_a_tenth_are_kept(spark):
    rnd = random.Random(33)
    a = prose(rnd, 320).split()
    b = [w if k % 10 == 0 else w + "x" for k, w in enumerate(a)]
    b[:3] = a[:3]
    out = linededup.drop_recurring_lines(docs_df(spark, [(1, " ".join(a)), (2, " ".join(b))])).collect()
    assert not any(r.n_dropped for r in out)


def test_a_leaf_holds_any_number_of_templates(spark, monkeypatch):
    """Log lines of one leaf and one start, of more templates than a round has candidates for."""
    for name, value in {"CANDIDATES": 2, "MOST_CANDIDATES": 4}.items():
        monkeypatch.setattr(linededup, name, value, raising=False)
    rnd = random.Random(24)
    bodies = [prose(rnd, 12) for _ in range(15)]
    docs = [(k, f"2024-01-01 10:00:{k} INFO svc worker {k}: {bodies[k % 15]} for {rnd.choice(VOCAB)} as {rnd.choice(VOCAB)}") for k in range(60)]
    kept = {r.doc_id for r in linededup.drop_recurring_lines(docs_df(spark, docs)).collect() if not r.n_dropped}
    assert kept == set(range(15))


def test_lines_of_numbers_recur_token_for_token(spark):
    rnd = random.Random(25)
    contact = "Tel 030 1234567 Fax 030 1234568"
    passage = " ".join(f"w{k}x" if k < 31 else VOCAB[k] for k in range(60))
    docs = [(k, "\n".join([prose(rnd, 9), contact, passage, contact[:-1] + "0" + str(k)])) for k in range(3)]
    for r in linededup.drop_recurring_lines(docs_df(spark, docs)).collect():
        lines = docs[r.doc_id][1].split("\n")
        assert r.text == "\n".join(lines if r.doc_id == 0 else [lines[0], lines[3]])


def test_long_lines_are_compared_whole(spark):
    """Labels in even places, values in odd ones: lines agree in little more than half of their tokens."""
    rnd = random.Random(26)
    labels = prose(rnd, 32).split()
    docs = []
    for k in range(6):
        values = [VOCAB[0], *(f"{rnd.choice(VOCAB)}{'abcdef'[k]}" for _ in range(31))]
        docs.append((k, " ".join(x for pair in zip(labels, values) for x in pair)))
    near = docs[0][1].split()
    docs.append((6, " ".join(near[:40] + [VOCAB[1]] * 4 + near[44:])))
    out = {r.doc_id: r.n_dropped for r in linededup.drop_recurring_lines(docs_df(spark, docs)).collect()}
    assert out == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1}


def test_plans_of_native_operators_hold_no_python(spark):
    for name in ("op1_linededup", "op4_urlfilter", "op5_chat", "op8_quality", "op9_secrets"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow")), name
