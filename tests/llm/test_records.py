import base64
import gzip
import hashlib
import random
import struct
import time
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docindex.llm import chat, media, packing, toxicity, warc
from docindex.session import new_path

from .helpers import EDGES, documents, saved

# Packing ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_encoder_is_the_tokenizer(tokenizer):
    path, plain = tokenizer
    encode = packing.WordEncoder(path)
    assert encode.by_word
    rng = random.Random(6)
    texts = ["".join(chr(rng.choice([rng.randrange(1, 256), rng.randrange(32, 127)])) for _ in range(60)) for _ in range(400)]
    texts += [chr(c) + "a" + chr(c) for c in range(1, 256)] + ["it's 'S we'll I'D x''s", "Straße ÀÉÎ ß µ", "日本 😀 İı é", "", "a1b22 ½²", "\x85\xa0x\x1c\x1fy"]
    texts += ["a <|endoftext|> b", "<|StartOfText|>x<|ENDOFTEXT|>", "<|endoftext", "é<|endoftext|>日"]
    for t in texts:
        assert encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_lengths_need_no_python_workers_of_their_own(spark):
    """A table made from a list comes out of Python workers of another kind than those of the tasks; both kinds stay in memory."""
    pieces = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "1 + id % 7 as length", "id as ids_crc32")
    out = packing.pack(pieces, 8)
    assert "ExistingRDD" not in out._jdf.queryExecution().toString()
    full = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert out.count() == 5000 and full.where("n <> end or n > 8").isEmpty()


def test_packing(spark, tmp_path, tokenizer):
    path, plain = tokenizer
    rng = random.Random(7)
    rows = EDGES + [(n, " ".join(rng.choice(["alpha", "be", "c", "delta!"]) for _ in range(rng.choice([3, 9, 90, 700, 1500, 2047, 2048, 5000])))) for n in range(60)]
    rows += rows[-2:]
    got = packing.op2_packing(spark, saved(tmp_path, documents(spark, rows))).collect()
    want = []
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    full: dict = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(full) <= -(-sum(w[3] for w in want) // 2048) + 2
    assert packing.pack_documents(documents(spark, []), path).count() == 0
    named = spark.createDataFrame([("x", "alpha be"), (None, None)], "doc_id string, text string")
    assert sorted(str(r["doc_id"]) for r in packing.pack_documents(named, path).collect()) == ["None", "x"]
    pieces = spark.createDataFrame([(1, 0, 5, 7, "b", 1, 2, 3, 4)], "doc_id long, piece int, length long, ids_crc32 long, base string, parts int, rank int, slot int, row int")
    assert packing.pack(pieces).collect()[0].asDict() == {"doc_id": 1, "piece": 0, "length": 5, "ids_crc32": 7, "base": "b", "parts": 1, "rank": 2, "slot": 3, "row": 4, "sequence_id": 0, "offset": 0}


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[rooms.index(fit)] = fit - n
    return len(rooms)


def test_plan_over_counts_is_best_fit():
    rng = random.Random(8)
    for _ in range(60):
        capacity = rng.choice([10, 64, 100])
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 200))]
        counts = {n: lengths.count(n) for n in lengths}
        sequences = {}
        for n, runs in packing.plan_best_fit(counts, capacity).items():
            ends = [*(r[0] for r in runs[1:]), counts[n]]
            for (start, first, each, offset), end in zip(runs, ends, strict=True):
                for k in range(end - start):
                    sequences.setdefault(first + k // each, []).append((offset + k % each * n, n))
        assert sum(map(len, sequences.values())) == len(lengths)
        for parts in sequences.values():
            assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
            assert sum(n for _, n in parts) <= capacity
        assert len(sequences) == best_fit(lengths, capacity)


# Toxicity -----------------------------------------------------------------------


def test_toxicity(spark, tmp_path):
    rng = random.Random(3)
    say = lambda n: " ".join("w%d" % rng.randrange(60) + "abcdefg"[rng.randrange(7)] for _ in range(n))
    rows, labels = [], []
    for n in range(600):
        bad = n % 5 == 0
        text = ". ".join(say(8) for _ in range(rng.randrange(1, 9)))
        rows.append((n, text + (f". you {rng.choice(['grumbix', 'grumbosa', 'snarfle'])} {say(3)}." if bad else "")))
        labels.append((n, int(bad)))
    sf = saved(tmp_path, documents(spark, rows + EDGES + [(None, "x")]))
    saved(tmp_path, spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int").withColumn("quality", F.lit(1)), "labels")
    got = toxicity.op8_toxicity(spark, sf).collect()
    assert len(got) == len(rows) + len(EDGES) + 1
    truth = dict(labels)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held) > 90
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    (where,) = toxicity.score_toxicity(documents(spark, [(1, "w1a w2b. You grumbix! w3c")]), model).collect()
    assert [(s["start"], s["end"]) for s in where["sentences"]] == [(8, 20)]
    none = toxicity.fit(documents(spark, []), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(documents(spark, EDGES), none).agg(F.max("score")).first()[0] < 1e-9


def test_features_are_counted_in_parts(monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTED", 500)
    rng = random.Random(5)
    rows = [(" ".join(f"{rng.choice('abcdef')}{chr(97 + rng.randrange(26))}{chr(97 + n % 26)}x" for _ in range(20)), n % 3 == 0) for n in range(400)]
    batches = [pa.RecordBatch.from_pydict({"text": [r[0] for r in part], "toxic": [r[1] for r in part]}) for part in (rows[:150], rows[150:])]
    got, sizes = {}, []
    for batch in toxicity._counts(iter(batches)):
        sizes.append(batch.num_rows)
        for r in batch.to_pylist():
            a, b = got.get(r["feature"], (0, 0))
            got[r["feature"]] = (a + r["n1"], b + r["n0"])
    want = {}
    for text, toxic in rows:
        for f in {f for w in set(text.split()) for f in toxicity.features(w)}:
            a, b = want.get(f, (0, 0))
            want[f] = (a + toxic, b + (not toxic))
    assert got == want and len(want) > 1000
    assert len(sizes) > 2 and max(sizes) <= 500 + 20 * 4


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = [(n, f"t{n % 3} word") for n in range(200)]
    labels = [(n, int(n % 3 == 0)) for n in range(200)]
    flipped = [(n, 1 - y if zlib.crc32(str(n).encode()) % 4 == 2 else y) for n, y in labels]
    docs = documents(spark, rows)
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.weights == b.weights and a.bias == b.bias


def test_rare_insults_in_a_large_sample(spark):
    rng = random.Random(4)
    say = lambda: " ".join("w%s" % "".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(9))
    insults = [f"{a}{b}grum" for a in "bcdfghjklm" for b in "aeiou"] + [f"{a}{b}snar" for a in "npqrst" for b in "aeiou"]
    rows, labels = [], []
    for n in range(8000):
        bad = n % 4 == 0
        rows.append((n, say() + (f". {rng.choice(insults)} {say()}" if bad else f". {say()}")))
        labels.append((n, int(bad)))
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    fresh = documents(spark, [(n, f"{say()}. {w} {say()}") for n, w in enumerate(insults)] + [(1000 + n, say()) for n in range(200)])
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(fresh, model).collect()}
    caught = sum(v >= toxicity.THRESHOLD for k, v in scores.items() if k < 1000)
    assert caught == len(insults) and sum(v >= toxicity.THRESHOLD for k, v in scores.items() if k >= 1000) <= 10


def test_scores_beside_columns_of_that_name(spark):
    docs = documents(spark, [(1, "x"), (2, None)]).withColumn("Score", F.lit("mine")).withColumn("sentences", F.lit(1))
    model = toxicity.Model({}, -30.0)
    out = toxicity.score_toxicity(docs, model)
    assert out.columns == [*(c for c in docs.columns if c not in ("Score", "sentences")), "score", "sentences"] and out.agg(F.max("score")).first()[0] < 1e-9
    out = toxicity.score_toxicity(docs, model, score_col="p", sentences_col="where")
    assert {r["Score"] for r in out.collect()} == {"mine"} and out.columns[-2:] == ["p", "where"]


# Media --------------------------------------------------------------------------


def png(body=b"x"):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(9) + b"\x02\x02\x4c\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02da\xff\x00ta\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHH", 60, 0, 54, 40, 1, 1, 1, 24) + bytes(30)
PDF = b"%PDF-1.4 x startxref 0 %%EOF"


def test_sniffing():
    find = media.automaton()
    whole = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/gzip": gzip.compress(b"abc"), "audio/wav": media.wav(b"abc")}
    for kind, blob in whole.items():
        assert media.sniff(blob, find)[0] == (kind, 0, len(blob))
        assert (kind, 5, len(blob)) in media.sniff(b"junk!" + blob + b"tail", find)
        if kind != "application/pdf":
            assert not any(s[0] == kind for s in media.sniff(blob[:-1], find))
    assert media.sniff(b"RIFF GIF89a \xff\xd8\xff BM %PDF- text only", find) == []
    broken = bytearray(png())
    broken[20] ^= 1
    assert media.sniff(bytes(broken), find) == []


def test_media_query(spark, tmp_path):
    rows = EDGES + [(1, "x" * 576), (2, "y" * 577), (3, "BM GIF89a RIFF")]
    got = {r["doc_id"]: r for r in media.op7_media(spark, saved(tmp_path, documents(spark, rows))).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r["media_bytes"] == len(payload) + 44 and r["media_sha256"] == hashlib.sha256(media.wav(payload)).hexdigest() and r["type"] == "audio/wav"
    assert got[904]["feature"] == got[905]["feature"]
    assert {r["declared_ok"] for i, r in got.items() if i % 3 == 0} == {True} and {r["declared_ok"] for i, r in got.items() if i % 3} == {False}


def test_media_of_any_kind(spark):
    df = spark.createDataFrame([(1, "image/gif", bytearray(png(GIF))), (2, "image/png", None), (3, "text/plain", bytearray(b"x"))], "id int, declared string, media binary")
    got = {r["id"]: r for r in media.sniff_media(df).collect()}
    assert got[1]["type"] == "image/png" and not got[1]["type_ok"] and [(e["type"], e["length"]) for e in got[1]["embedded"]] == [("image/gif", len(GIF))]
    assert got[2]["type"] is None and got[2]["media_bytes"] is None and got[3]["type"] is None


def test_carving(spark):
    inside = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "application/gzip": gzip.compress(b"abc")}
    rows = [(n, bytearray(media.wav(b"\x80" * 50 + blob + b"\x80" * n)), kind, "mine") for n, (kind, blob) in enumerate(inside.items())]
    rows += [(9, bytearray(media.wav(b"plain")), "", "mine"), (10, None, "", "mine"), (11, bytearray(b"junk" + GIF), "image/gif", "mine")]
    df = spark.createDataFrame(rows, "id int, media binary, holds string, carved string")
    got = {r["id"]: r for r in media.carve_media(df).collect()}
    assert {*got} == {0, 1, 2, 3, 4, 11}
    for r in got.values():
        assert r["carved_type"] == r["holds"] and bytes(r["carved"]) == inside[r["holds"]] and r["carved_start"] == (4 if r["id"] == 11 else 94)
    clash = df.withColumns({"declared": F.lit("audio/wav"), "type": F.lit(1), "Feature": F.lit(2)})
    assert {r["type"] for r in media.sniff_media(clash).collect()} == {"audio/wav", None}


def test_validators_take_linear_time():
    find = media.automaton()
    for blob in (b"%PDF-1." * 200_000, b"\x1f\x8b\x08" * 200_000, b"\x89PNG\r\n\x1a\n" * 100_000, (b"\x89PNG\r\n\x1a\n" + b"\x00\x01\x00\x00IHDR") * 50_000, b"RIFF" * 200_000, b"GIF89a" * 100_000, b"GIF89aABCDEFG!xyz" * 300_000, b"\xff\xd8\xff\xda\x00\x02abc\xff\x00" * 100_000, b"\xff\xd8\xff\xe0\x00\x07abc" * 100_000):
        began = time.process_time()
        assert media.sniff(blob, find) == []
        assert time.process_time() - began < 10


# Chats --------------------------------------------------------------------------


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, turn long, role string, text string")


def test_preferences(spark):
    chosen = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "good 😀"), (1, 2, "user", "bye"), (2, 0, "user", "same"), (3, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "a"), (4, 2500, "assistant", "b")])
    rejected = turns(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", "same"), (4, 0, "user", "a")])
    got = {(r["pair_id"], r["part"]): r for r in chat.format_preferences(chosen, rejected).collect()}
    r = got[1, 0]
    assert (r["n_common"], r["n_chosen"], r["n_rejected"]) == (1, 2, 1)
    assert r["prompt"] == "<|user|>\nhi<|end|>\n" and r["chosen"] == "<|assistant|>\ngood 😀<|end|>\n<|user|>\nbye<|end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_mask"]] == ["good 😀<|end|>"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_mask"]] == ["bad<|end|>"]
    assert got[2, 0]["n_common"] == 1 and got[2, 0]["chosen"] == ""
    assert got[3, 0]["chosen"] == "<|user|>\n<|end|>\n" and got[3, 0]["n_rejected"] == 0
    assert got[4, 0]["chosen"] == "<|assistant|>\nb<|end|>\n" and got[4, 0]["prompt"] == "<|user|>\na<|end|>\n"
    assert {*got} == {(n, 0) for n in (1, 2, 3, 4)}
    assert chat.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


def test_long_conversations(spark, monkeypatch):
    said = [(n, "user" if n % 2 == 0 else "assistant", f"turn {n}") for n in range(2500)]
    chosen, rejected = turns(spark, [(7, *s) for s in said]), turns(spark, [(7, *s) for s in said[:-1]] + [(7, 2499, "assistant", "no")])
    (r,) = chat.format_preferences(chosen, rejected).collect()
    assert (r["part"], r["n_common"], r["n_chosen"], r["n_rejected"]) == (0, 2499, 1, 1)
    assert r["prompt"] == "".join(f"<|{w}|>\n{t}<|end|>\n" for _, w, t in said[:-1])
    monkeypatch.setattr(chat, "PART_CHARS", 60_000)  # too long for a row: later turns go on in another
    parts = sorted(chat.format_preferences(chosen, rejected).collect(), key=lambda r: r["part"])
    assert len(parts) > 1 and "".join(p["prompt"] for p in parts) == r["prompt"] and "".join(p["chosen"] for p in parts) == r["chosen"]


# WARC ---------------------------------------------------------------------------


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_warc(spark, tmp_path):
    rng = random.Random(1)
    bodies = [None, "", "a\r\n\r\nWARC/1.1\r\n", "é😀" * 50, "x" * 200_000, *("p%d" % rng.randrange(9) for _ in range(60))]
    rows = [(n, f"http://h/{n}\r\nX: y", b) for n, b in enumerate(bodies)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.op10_warc(spark, saved(tmp_path, df, "pages")).collect()}
    first: dict = {}
    for n, b in enumerate(bodies):
        first.setdefault(b or "", n)
    for n, b in enumerate(bodies):
        r, origin = got[n], first[b or ""]
        assert (r["payload_bytes"], r["payload_digest"], r["digest_ok"]) == (len((b or "").encode()), sha(b or ""), True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if origin == n else ("revisit", origin))


def test_warc_edges(spark):
    rows = [(None, "u", "same"), (5, "u", "same"), (5, "u", "same"), (9, None, "same"), (None, "v", "other")]
    path = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["html"]) for r in warc.read_archives(spark, path).collect()), key=str)
    assert got == [(5, "response", None, "same"), (5, "response", None, "same"), (9, "revisit", 5, None), (None, "response", None, "other"), (None, "revisit", 5, None)]
    records = [h for part in Path(path).glob("part-*.gz") for h, _ in warc.parse_archive(gzip.decompress(part.read_bytes()))]
    ids = {h["warc-record-id"] for h in records if h["warc-type"] == "response"}
    assert all(h["warc-refers-to"] in ids for h in records if h["warc-type"] == "revisit")
    path = new_path(spark, "test-warc")
    small = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    warc.write_archives(small, path, min_bytes=3)
    assert {r["record_type"] for r in warc.read_archives(spark, path).collect()} == {"response"}
    with gzip.open(next(Path(path).glob("part-*.gz"))) as f:
        assert len([*warc.parse_archive(f.read())]) in (1, 2)
    path = new_path(spark, "test-warc")
    warc.write_archives(small.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


# SQL ----------------------------------------------------------------------------


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data here")
@pytest.mark.parametrize("name", ["op9_chat", "op10_warc"])
def test_sql_twin(spark, name):
    import duckdb

    from docindex import llm

    con = duckdb.connect()
    for table in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    got = llm.QUERIES[name](spark, "/root/testdata/sf0.001")
    cursor = con.execute(llm.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, cursor.fetchall()))
