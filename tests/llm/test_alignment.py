import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docindex.llm import alignment

from .helpers import EDGES, documents, saved

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def bytes_to_characters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def plain_tokens(texts):
    """Ids and bytes of tokens, the whole text at once."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, byte = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), bytes_to_characters()
    a.encode_special_tokens = True
    for text in texts:
        if not text:
            yield [], []
            continue
        left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[1:-1], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        same = b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
        yield (left, right) if same else ([], [])


def brute(rows):
    parts, counts = [], Counter()
    for (doc, _), (left, right) in zip(rows, plain_tokens([t for _, t in rows]), strict=True):
        ends_a, ends_b = np.cumsum([len(x) for _, x in left]).tolist(), np.cumsum([len(x) for _, x in right]).tolist()
        links = [(i, j) for i, p in zip([x for x, _ in left], ends_a, strict=True) for j, q in zip([x for x, _ in right], ends_b, strict=True) if p == q] if len(left) < 150 else [(left[ends_a.index(e)][0], right[ends_b.index(e)][0]) for e in sorted({*ends_a} & {*ends_b})]
        counts.update(links)
        groups, i, j = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(str(x) for x, _ in left[i:k]) + "|" + ",".join(str(x) for x, _ in right[j:m]))
            i, j = k, m
        parts.append((doc, len(left), len(right), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted((d, a, b, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, x in parts)


def test_alignment_against_brute_force(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = ["the", "Überweisung", "naïve", "can't", "日本", "😀", "x1y2", "...", "\t", "\n", " ", "", "<|endoftext|>", "</s>", "<0x41>", "ing,", "🏳️‍🌈", "\r\n", " ", " a"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", rng.choice(words)]) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += EDGES[:6] + [(907, "x" * 3000), (908, "word " * 1000), (909, "a▁b"), (910, " lead"), (911, "trail "), (912, "\x00nul"), (3, "twice"), (3, "twice")]
    got = alignment.op12_alignment(spark, saved(tmp_path, documents(spark, rows)))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_given_documents(spark):
    got = {r["doc_id"]: tuple(r) for r in alignment.op12_alignment(spark, "/root/testdata/sf0.001").collect()}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert got == {r[0]: r for r in brute(rows)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40), st.lists(st.integers(1, 4), max_size=40), st.integers(1, 9))
def test_pieces_of_any_size_give_the_same(x, y, piece):
    a, b = np.cumsum(x), np.cumsum(y)
    end = max(a[-1] if len(a) else 0, b[-1] if len(b) else 0)
    if end:
        a, b = (np.append(e[e < end], end).astype(np.int64) for e in (a, b))
    else:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = alignment.merge_path(a, b, piece)
    assert [p + q for p, q in cuts] == [*range(0, len(a) + len(b), piece), len(a) + len(b)]
    order = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
    assert [p for p, _ in cuts] == [sum(1 for v in order[: p + q] if v[1] == 0) for p, q in cuts]
    left, right, together, group = alignment.align_ends(a, b, piece)
    starts_a, starts_b = np.append([0], a[:-1]), np.append([0], b[:-1])
    want = sorted((i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i])
    assert [*zip(left.tolist(), right.tolist(), strict=True)] == want
    assert together.tolist() == [bool(a[i] == b[j]) for i, j in want]
    assert group.tolist() == [sum(1 for e in {*a.tolist()} & {*b.tolist()} if e <= max(starts_a[i], starts_b[j])) for i, j in want]


def test_columns_of_any_name_and_empty_tables(spark):
    docs = spark.createDataFrame([("k", "a text", 1, 2)], "text2 string, text string, n_a int, row int")
    out = alignment.align_tokens(docs, A, B)
    assert out.columns == ["text2", "text", "row", "n_a", "n_b", "n_groups", "n_links", "pairs", "groups"]
    row = alignment.score_links(out, alignment.pair_counts(out)).first()
    assert (row["text2"], row["row"], row["n_a"], row["n_links"], row["n_best"]) == ("k", 2, 2, 2, 2)
    assert alignment.align_tokens(docs.where("false"), A, B).count() == 0


def test_small_batches_and_a_small_memory(spark, monkeypatch):
    rows = [(i, f"some words {i} and others {i % 3} " * (i % 5)) for i in range(40)]
    tok = alignment.TwoTokenizers(A, B)
    want = [tuple(x.tolist() for x in p) for p in tok([t for _, t in rows])]
    monkeypatch.setattr(alignment, "KEPT", 5)
    monkeypatch.setattr(alignment, "LONGEST", 4)
    tok = alignment.TwoTokenizers(A, B)
    assert [tuple(x.tolist() for x in p) for p in tok([t for _, t in rows])] == want
