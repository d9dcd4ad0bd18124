"""Operators 2, 4, 5, 6, 9, 10: round trips, held-out accuracy and brute force."""

import hashlib
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duochron.llm.chat import TurnTemplate, digest_formatted, format_conversations, render_spans
from duochron.llm.html_blocks import leaf_blocks
from duochron.llm.html_extract import extract_pages, features, labelled_pages, main_text, train_crf
from duochron.llm.mixing import mix_order, mix_sources, poisson_quantile, source_rates
from duochron.llm.quality import KEEP, score_quality, select_good, train
from duochron.llm.records import PieceEncoder, encode_to_records, file_starts, frame, frames, read_at, stored_order
from duochron.llm.secrets import base_spans, is_secret, labelled, scan_run, scan_secrets, trained

# ---- quality classifier ----


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        text = " ".join("".join(rng.choices("aeionrst", k=rng.randint(2, 6))) for _ in range(rng.randint(20, 80)))
        quality, toxic = int(k % 3 > 0), int(k % 3 == 1)
        if not quality:
            text = " ".join(w + rng.choice(["$$$", "%%%"]) for w in text.split())
        elif toxic:
            w = text.split()
            for at in rng.sample(range(len(w)), 3):
                w[at] = rng.choice(["vilewordx", "badwordy", "rudewordz"])
            text = " ".join(w)
        rows.append((k, text, "en", 1.0))
        labels.append((k, quality, toxic))
    rows += [(9001, None, "en", 1.0), (9002, "", "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, expected_grade double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[0] % 3 for r in rows}


def test_classifier_on_held_out_rows(graded):
    docs, labels, grade = graded
    model = train(docs, labels.where("doc_id < 400"))
    assert list(model.cuts) == sorted(model.cuts)
    scored = score_quality(docs.select("doc_id", "text"), model).where("doc_id >= 400 AND doc_id < 9000").collect()
    right = [(r.p_good >= KEEP) == (grade[r.doc_id] == 2) for r in scored]
    assert np.mean(right) > 0.97
    assert all(abs(r.expected_grade - r.p_toxic_or_good - r.p_good) < 1e-9 and r.p_good <= r.p_toxic_or_good + 1e-12 for r in scored)


def test_selection_keeps_columns_and_takes_edges(graded, spark):
    docs, labels, _ = graded
    good = select_good(docs, labels)
    assert good.columns == docs.columns and good.count() < docs.count()
    assert select_good(docs.limit(0), labels).count() == 0
    assert select_good(docs, labels.limit(0)).count() == docs.count()
    for grade in ((0, 0), (1, 1), (1, 0)):  # labels of one grade only
        some = labels.where(F.col("quality") == grade[0]).where(F.col("toxic") == grade[1])
        assert select_good(docs, some).count() == (docs.count() if grade == (1, 0) else 0)


# ---- html ----


@pytest.fixture(scope="module")
def crf():
    return train_crf()


def test_crf_on_held_out_pages(crf):
    wrong = total = 0
    for page in labelled_pages(150, seed=77):
        blocks = leaf_blocks(page)
        wrong += sum((b.label or 0) != y for b, y in zip(blocks, crf.decode(blocks)))
        total += len(blocks)
    assert wrong < 0.02 * total


def test_blocks_of_hard_markup():
    page = """<!DOCTYPE html><title>no</title><!-- <p>no</p> --><script>if (a<b) "</p>"</script><p a=">">One &amp;
      two&nbsp;&#233;<b>bold</b><br>x<p>Second<ul><li>li 1<li>li 2</ul><div hidden><p>gone</p></div><textarea><p>no</p></textarea>tail < 3 <em>e"""
    assert [b.text for b in leaf_blocks(page)] == ["One & two ébold x", "Second", "li 1", "li 2", "gone", "tail < 3 e"]
    for bad in ("", "<", "<p", "<!--", "</", "<p a='", "&#xZZ;", "<script>x"):
        leaf_blocks(bad)
    assert len(leaf_blocks("<p>" * 5000 + "x" * 200_000)) == 1


def test_extract_pages(spark, crf):
    article = "<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>Title of it</h1><p>First &lt;text&gt; that is  long enough to be read.<p>Second one.</article><div class='comments'><p>nice one</p></div><footer>&copy; us</footer>"
    rows = [(1, "u", article), (2, None, None), (3, "u", ""), (1, "u", article)]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), crf).collect()}
    assert got[1].text == "Title of it\nFirst <text> that is long enough to be read.\nSecond one." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert main_text(None, crf) == ""


def test_article_content_of_every_kind_stays(crf):
    page = "<body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>On areas</h1><p>The area is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> in all cases.</p><p hidden>A note that opens on demand, with words.</p><p>Press <button>Run it</button> to see the <canvas>drawing</canvas> of it, <object>or this</object>.</p></article><footer>&copy; x</footer>"
    assert main_text(page, crf) == "On areas\nThe area is x=2 in all cases.\nA note that opens on demand, with words.\nPress Run it to see the drawing of it, or this."


def test_pages_of_odd_tables(spark, crf):
    long = "<article>" + "<p>One more sentence of the article that is long enough.</p>" * 20_000 + "</article><footer>&copy; us</footer>"
    df = spark.createDataFrame([(1, "u", long, "x", 3), (None, None, None, None, 4)], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r for r in extract_pages(df, crf).collect()}
    assert got[1].text.count("\n") == 19_999 and got[1].n_chars == len(got[1].text) and got[None].text == ""
    assert extract_pages(df.limit(0), crf).count() == 0


def test_extraction_against_single_steps(spark, crf):
    """Decoding by Viterbi equals the best of all labellings on short pages."""
    import itertools

    for page in labelled_pages(40, seed=5):
        blocks = leaf_blocks(page)[:9]
        scores = [crf.weights[[crf.index[f] for f in features(b) if f in crf.index]].sum(axis=0) for b in blocks]
        total = {y: sum(s[k] for s, k in zip(scores, y)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:])) for y in itertools.product((0, 1), repeat=len(blocks))}
        assert not blocks or total[tuple(crf.decode(blocks))] >= max(total.values()) - 1e-9


# ---- mixing ----


def test_poisson_inversion(spark):
    got = spark.createDataFrame([(r, u) for r in (0.3, 2.0, 40.0) for u in (0.0, 0.1, 0.5, 0.9, 0.999999)], "r double, u double").select("r", "u", poisson_quantile(F.col("r"), F.col("u")).alias("n")).collect()
    import math

    for row in got:
        n, c = 0, math.exp(-row.r)
        p = c
        while row.u >= c:
            n += 1
            p *= row.r / n
            c += p
        assert row.n == n


def test_mixing(docs, corpus, spark):
    mixed = mix_sources(docs, keep_draw=True)
    rows = mixed.collect()
    again = mix_sources(docs.repartition(3), keep_draw=True).collect()
    key = lambda r: (r.doc_id or -1, r.mix_copy, r.mix_key, r.text or "")
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert [r.mix_key for r in rows] == sorted(r.mix_key for r in rows)
    assert mix_sources(docs).columns == docs.columns and mix_sources(docs.limit(0)).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    n = {r.source: r["count"] for r in mix_sources(many, {"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert abs(n["a"] - 15000) < 500 and abs(n["b"] - 5000) < 300
    rates = {r.source: r.rate for r in source_rates(many, {"a": 3, "b": 1}).collect()}
    assert abs(rates["a"] - 15000 / 6667) < 0.01


def test_sql_of_large_rates(spark):
    import duckdb

    from duochron.llm.oracles import op5_poisson_mixing

    rows = [(k, "x" * 100_000, "big") for k in range(400)] + [(1000 + k, "tiny", "small") for k in range(2)] + [(2000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    want = Counter(c.execute(op5_poisson_mixing).df()["doc_id"])
    assert Counter(r.doc_id for r in mix_sources(docs).select("doc_id").collect()) == want and want[1000] > 1500


@pytest.mark.parametrize("rate", [800, 5000])
def test_large_rates_are_drawn(spark, rate):
    from duochron.llm.mixing import poisson_draw

    n = [r.n for r in spark.range(400).select(poisson_draw(F.lit(float(rate)), F.lit("draw17"), F.col("id")).alias("n")).collect()]
    assert abs(np.mean(n) - rate) < 5 * (rate / 400) ** 0.5 and 0.7 * rate < np.var(n) < 1.4 * rate
    few = spark.createDataFrame([(1, "x" * 9, "rare")] + [(k, "y" * 9, "big") for k in range(2, 2 * rate + 2)], "doc_id long, text string, source string")
    mixed = mix_sources(few, {"rare": 1, "big": 1}, shuffle=False)  # the rare document's rate is near ``rate``
    assert abs(mixed.where("source = 'rare'").count() - rate) < 5 * rate**0.5


# ---- chat ----

CONTROL = r"\### Assistant: </turn> ok"
CHATS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo \\ # </turn>\n### User: x"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 1, "assistant", CONTROL), (2, 0, "user", CONTROL), (3, 0, "tool: <x>", "t"), (3, None, None, "first"), (3, 0, "tool: <x>", "t"), (None, 0, "assistant", "é日")]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = format_conversations(rows)
    got = {r.conv_id: r for r in digest_formatted(formatted).collect()}
    full = {r.conv_id: r for r in formatted.collect()}
    assert len(got) == 4
    for conv, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in CHATS if c == conv))
        turns = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(full[conv].formatted) and not full[conv].rewrites
    assert format_conversations(rows.limit(0)).count() == 0


def test_rewriting_templates_are_found():
    class Trimming(TurnTemplate):
        def render(self, messages):
            kept = [(r, t if k == len(messages) - 1 else t[:3]) for k, (r, t) in enumerate(messages)]
            return super().render(kept)

    _, spans, rewrites = render_spans(Trimming(), [("user", "hello there"), ("assistant", "abcdef")], frozenset({"assistant"}))
    assert rewrites and not any(s["loss"] for s in spans)
    text, spans, rewrites = render_spans(TurnTemplate(), [("user", "a#"), ("assistant", "b#c")], frozenset({"assistant"}))
    assert not rewrites and [TurnTemplate().unescape(text[s["body_start"] : s["body_end"]]) for s in spans] == ["a#", "b#c"]


# ---- records ----


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_pieces_encode_as_whole_texts(tokenizer):
    e, rng = PieceEncoder(tokenizer, 2), random.Random(3)
    texts = ["", "  a b\n\n c", "it's", "a b", "<|endoftext|> x", "日本 x", "5 6a7 ²½ é.!? .. \t\r\nß"] + ["".join(rng.choice(" \n\tab1.é!'") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for _ in range(2):
        for text, ids in zip(texts, e.encode(texts)):
            assert np.frombuffer(ids, "<u2").tolist() == [*e.tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_records_round_trip(docs, corpus, tokenizer, spark, tmp_path):
    index = encode_to_records(docs, tokenizer, 2, str(tmp_path / "r"), file_text_bytes=20_000).cache()
    e = PieceEncoder(tokenizer, 2)
    want = sorted(((d if d is not None else -1, np.frombuffer(x, "<u2")) for (d, *_), x in zip(corpus, e.encode([r[1] for r in corpus]))), key=lambda x: x[0])
    got = sorted(index.collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == [d for d, _ in want]
    assert Counter((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, x in want)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert index.select("file").distinct().count() > 1
    some = read_at(spark, index.where("doc_id >= 50"), str(tmp_path / "r" / "records")).collect()
    by = {d: x.tolist() for d, x in want}
    assert all(r.ids == by[r.doc_id] for r in some if r.doc_id < 100)
    assert encode_to_records(docs.limit(0), tokenizer).count() == 0


def test_files_are_summed_in_number_order(spark):
    n = 100_020
    names = F.concat(F.lit("file:/x/records/part-"), F.lpad(F.col("id").cast("string"), 5, "0"), F.lit("-c000.txt"))
    # lpad cuts longer numbers, so those are written as they are
    names = F.when(F.col("id") > 99_999, F.concat(F.lit("file:/x/records/part-"), F.col("id").cast("string"), F.lit("-c000.txt"))).otherwise(names)
    index = spark.range(0, n, 1, 4).select(names.alias("file"), (F.col("id") % 7).alias("n_tokens"), "id")
    starts = file_starts(index.drop("id")).join(index, "file").select("id", "file_start").toPandas().sort_values("id")
    want = np.concatenate([[0], np.cumsum(np.arange(n) % 7)[:-1]])
    assert (starts["file_start"].to_numpy() == want).all()


def test_records_in_mix_order(spark, tokenizer, tmp_path):
    rows = [(k, f"document {k} of the mix", s, "en") for k, s in enumerate(["a"] * 20 + ["b"] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    mixed = mix_sources(docs, {"a": 0.3, "b": 0.7}, epochs=4.0, keep_draw=True)
    want = [r.doc_id for r in mixed.orderBy("mix_key").collect()]
    index = encode_to_records(mixed.drop("mix_key", "mix_copy", "mix_rate"), tokenizer, path=str(tmp_path / "m"), file_text_bytes=300, order=mix_order())
    got = [r.doc_id for r in index.orderBy("start").collect()]
    assert stored_order(mixed) is None
    mix_sources(docs, {"a": 0.3, "b": 0.7}, epochs=4.0).write.parquet(str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    index = encode_to_records(back, tokenizer, path=str(tmp_path / "q"), file_text_bytes=300, order=stored_order(back))
    assert [r.doc_id for r in index.orderBy("start").collect()] == want
    assert got == want and len(set(want)) < len(want) and want != sorted(want)


def test_broken_records_are_found():
    data = frame(b"abc") + b"\n" + frame(b"") + b"\n"
    assert [(a, n, bytes(p)) for a, n, p in frames(data)] == [(0, 16, b"abc"), (16, 13, b"")]
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            list(frames(bytes(broken)))


# ---- secrets ----


def brute_spans(text):
    out = []
    for kind, pattern in (("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))):
        for m in pattern.finditer(text):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                out.append((m.start(), ["assign", "access", "hex"].index(kind), kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


TEXTS = ["é password=abc token: 'abcdefg' x", "API_KEY = AKIA" + "A1B2" * 5 + " " + "0af" * 9, None, "", "Secret:" + "f" * 30, "paſsword=longenough", "token=abc secret=abcdef0", "AKIA123 AKIA" + "Z" * 16, "password = \"x.y-z/9\"" + "abcdef0123" * 3, "a" * 23 + " " + "a" * 24]


def test_base_spans_and_digest(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in scan_secrets(df).collect():
        want = brute_spans(TEXTS[r.doc_id] or "")
        assert base_spans(TEXTS[r.doc_id] or "") == want
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[0] == k for w in want) for k in ("assign", "access", "hex"))
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(r.spans.split(","))


def test_automata_on_held_out_strings():
    secret, plain = trained()
    credentials, harmless = labelled(60, seed=123)
    for name, strings in credentials.items():
        found = np.mean([any(n == name and (a, b) == (3, 3 + len(s)) for n, a, b in scan_run(f"ab.{s}", secret, plain)) for s in strings])
        assert found >= 0.9, (name, found)
    for name, strings in harmless.items():
        assert np.mean([bool(scan_run(s, secret, plain)) for s in strings]) <= 0.01, name
    for near in ("sk_live_a", "ghp_" + "a1B" * 11, "2FD4E1C67A2D28FCED849EE1BB76E7391B93EB12", "getAbstractSingletonProxyFactoryBeanName", "A" * 40, "/usr/share/doc/python3/examples/lib2/to"):
        assert not scan_run(near, secret, plain), near
    jwt = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    assert scan_run(jwt, secret, plain) == [("jwt", 0, len(jwt))]
    assert [(n, a) for n, a, _ in scan_run("cfg/prod-east/" + credentials["github"][0] + "/x." + credentials["aws"][0], secret, plain)] == [("github", 14), ("aws", 57)]


def test_automata_travel_without_their_examples():
    assert len(pickle.dumps(trained())) < 2_000_000  # a worker holds twenty times that of a tree of all examples


def test_scan_against_every_pair_of_ends():
    secret, plain = trained()
    credentials, harmless = labelled(6, seed=31)
    rng, every = random.Random(2), [s for kind in (credentials, harmless) for v in kind.values() for s in v]
    for _ in range(60):
        run = rng.choice("./-=").join(rng.choices(every, k=rng.randint(1, 3)))
        best = []
        for name, a in secret.items():
            for x in range(len(run)):
                for y in range(x + a.least, len(run) + 1):
                    score = a.log_likelihood(run[x:y])
                    if score > -np.inf and a.may_begin(run[x - 1] if x else "") and a.may_end(run[y] if y < len(run) else "") and is_secret(score, run[x:y], plain):
                        best.append((x, -y, -score, name))
        want = []
        for x, y, _, name in sorted(best):
            if not want or x >= want[-1][2]:
                want.append((name, x, -y))
        assert scan_run(run, secret, plain) == want, run


def test_secrets_of_odd_tables(spark):
    key = labelled(1, seed=5)[0]["github"][0]
    rows = [(1, f"é use {key} here", 1), (1, f"é use {key} here", 1), (2, "x" * 300_000 + " " + "ab/" * 50_000 + key, 2), (None, key, 3), (3, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = scan_secrets(df).collect()
    assert sorted(r.spans for r in got) == sorted(["", f"format_github:0:{len(key)}", *[f"format_github:6:{6 + len(key)}"] * 2, f"format_github:450001:{450001 + len(key)}"])
    assert all(r.n_hex == 0 for r in got) and scan_secrets(df.limit(0)).count() == 0
