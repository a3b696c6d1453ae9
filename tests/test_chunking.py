import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docindex.functions import text as t
from docindex.helpers.bpe import BpeCounter
from docindex.operators import chunking


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns))


def value(df, col):
    return df.select(col.alias("v")).first()["v"]


def test_sections(spark):
    content = "pre\n\n# A\nbody\n## B b\n\nx # no\n####### seven\n#\n## odd\nend"
    rows = chunking.split_sections(one(spark, content=content)).collect()
    assert [r["section_title"] for r in rows] == ["", "A", "B b", "## odd"]
    assert rows[0]["section"] == "pre"
    assert rows[3]["section"] == "#\n## odd\nend"
    assert value(one(spark, content="no heading "), chunking.sections_of(F.col("content")))[0]["section"] == "no heading "


GATE = "intro words here\n\n# Foo(int a)\nshort\n\n# Bar\none two three four"


@pytest.mark.parametrize(("least", "most", "starts", "symbols"), [(4, 10, ["# Foo", "# Bar"], ["Foo", "Bar"]), (8, 10, ["# Foo", "# Bar"], ["Foo", "Bar"]), (8, 20, ["# Foo"], ["Foo"]), (3, 10, ["intro", "# Foo", "# Bar"], ["", "Foo", "Bar"])])
def test_gate_and_merge(spark, least, most, starts, symbols):
    docs = one(spark, source_file="a/b.md", title="t", content=GATE)
    rows = chunking.chunk_documents(docs, most, least).orderBy("chunk_no").collect()
    assert [r["symbol"] for r in rows] == symbols
    assert all(r["content"].startswith(s) for r, s in zip(rows, starts, strict=True))
    assert [r["chunk_no"] for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a b c\n\nd e f\n\ng", ["a b c", "d e f\n\ng"]),
        ("a b c d e f g", ["a b c d e f g"]),
        ("a\n\n```\n\nx\n```\n\nb c d e", ["a", "```\n\nx\n```", "b c d e"]),
        ("a b\n```x```", ["a b", "```x```"]),
    ],
)
def test_packing(spark, text, want):
    got = value(one(spark, s=text), chunking.pack_parts(F.col("s"), 5))
    assert [c["content"] for c in got] == want


def test_fence_joins_its_paragraph(spark):
    got = value(one(spark, s="a b\n\n```x```\n\n" + "w " * 20), chunking.pack_parts(F.col("s"), 12))
    assert got[0]["content"] == "a b\n```x```"


def test_edge_documents(spark):
    rows = [("n", None), ("e", ""), ("w", " \n "), ("u", "a\u0001b"), ("long", "word " * 25_000)]
    df = spark.createDataFrame(rows, "source_file string, content string").withColumn("title", F.lit("t"))
    got = {r["source_file"]: r for r in chunking.chunk_documents(df, 800, 0).collect()}
    assert set(got) == {"u", "long"}
    assert got["u"]["content"] == "ab" and got["long"]["tokens"] == 25_000


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "# H", "c!"]), min_size=1, max_size=6), max_size=8))
def test_text_keeps_its_order(spark, paragraphs):
    text = "\n\n".join(" ".join(p) for p in paragraphs)
    df = one(spark, source_file="f", title="t", content=text)
    rows = chunking.chunk_documents(df, 7, 0).orderBy("chunk_no").collect()
    assert "".join("".join(r["content"] for r in rows).split()) == "".join(text.split())
    assert all(r["tokens"] <= 7 or "\n\n" not in r["content"] for r in rows)


def test_both_versions_agree(spark):
    import re

    count = lambda s: len(re.findall(r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n\f]", s))
    texts = [GATE, "a\n\n```\n\nx\n```\n\nb c d e", "pre\n\n# A\nbody (x)\n## B b\n\n" + "w x y z\n\n" * 9 + "# C\nint f(a)\n", "one\u0001two", "   # no\n#\n## odd\nend", "é " * 30]
    df = spark.createDataFrame([(f"d/{n}.md", "t", x) for n, x in enumerate(texts)], "source_file string, title string, content string")
    for most, least in ((5, 1), (10, 4), (20, 8), (800, 0)):
        native = sorted(map(tuple, chunking.chunk_documents(df, most, least).collect()))
        assert native == sorted(map(tuple, chunking.chunk_documents_with(df, count, most, least).collect()))


def test_text_functions(spark):
    df = one(spark, p="root/html/Core/x.y.html", q="a/b/c/d.htm", r="d.htm", s="abcdef", ws=" a \n\n\n\nb 　\n", e="a\n\n b", em="😀é" * 3)
    assert value(df, t.module_of("p")) == "root/Core" and value(df, t.chapter_of("p")) == "root/html/Core/x.y"
    assert value(df, t.module_of("q")) == "b/c" and value(df, t.chapter_of("q")) == "a/b/c/d"
    assert value(df, t.module_of("r")) == "" and value(df, t.chapter_of("r")) == "d"
    assert value(df, t.truncate("s", 5)) == "ab..." and value(df, t.truncate("s", 6)) == "abcdef"
    assert value(df, t.truncate("em", 5)) == "😀é..."
    assert value(df, t.clean_whitespace("ws")) == "a\n\nb"
    assert value(df, t.clean_embed_text("e")) == "a b"
    assert value(one(spark, a="abc"), t.content_hash("a")) == "900150983cd2"


@pytest.mark.parametrize(
    ("title", "content", "want"),
    [
        ("Class.method(int a)", "", "Class.method"),
        ("", "some prose (aside) here", "prose"),
        ("", "def go(x):", "go"),
        ("", "export const run = async (a)", "run"),
        ("", "k:function(a)", "k"),
        ("", "k: function(a)", "function"),  # two words before parentheses come first
        ("", "std::vector<int> make (int a);", "make"),
        ("", "alone(x)", ""),
        ("", "word " * 20_000 + "f(", ""),  # a long run neither overflows nor stalls
    ],
)
def test_symbols(spark, title, content, want):
    assert value(one(spark, t=title, c=content), t.extract_symbol("t", "c")) == want


def test_byte_pair_counts(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = ["Hello world, hello!", "", None, "日本 <|endoftext|> é", "x" * 500 + "\n\n y"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = {r["n"]: r["k"] for r in df.select("n", t.count_bpe_tokens("t", path).alias("k")).collect()}
    want = {n: None if t is None else len(plain.encode(t, add_special_tokens=False).ids) for n, t in enumerate(texts)}
    assert got == want
    docs = spark.createDataFrame([("a.md", "A", "# A\n\n" + "\n\n".join("many words in a row " * 20 for _ in range(30)))], "source_file string, title string, content string")
    chunks = chunking.chunk_documents_with(docs, BpeCounter(path), 300, 20).collect()
    assert len(chunks) > 5 and all(c["tokens"] <= 300 and c["tokens"] == len(plain.encode(c["content"], add_special_tokens=False).ids) for c in chunks)


CL100K_LIKE = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
_PIECES = st.lists(st.sampled_from(["a", "B", " ", "  ", "\n", "\t", "'s", "'", "12", "345", ".", "!?", "é", "日", "😀", "\r\n", "\x1c", "\x85", "word", "```"]), max_size=8).map("".join)


@pytest.mark.parametrize("pattern", [None, CL100K_LIKE])
def test_counts_of_joined_texts_add_up(pattern):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    counter = BpeCounter(path, pattern) if pattern else BpeCounter(path)

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(_PIECES, min_size=1, max_size=5), st.lists(st.sampled_from(["\n", "\n\n", "", " "]), min_size=4, max_size=4))
    def run(texts, between):
        now = counter.measure(texts[0])
        assert now.tokens == counter(texts[0])
        for gap, text in zip(between, texts[1:], strict=False):
            now = counter.join(now, gap, counter.measure(text))
            assert now.tokens == counter(now.text)

    run()


def test_byte_pair_chunks_as_if_counted_anew(spark):
    import random
    import time

    public_tokenizers = pytest.importorskip("public_tokenizers")
    counter = BpeCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(2)
    word = lambda: rng.choice(["alpha", "Beta", "x1", "naïve", "foo()", "a.b", "!", "12345", "It's", "日本語"])
    para = lambda: " ".join(word() for _ in range(rng.randrange(1, 40)))
    texts = []
    for _ in range(30):
        parts = [rng.choice([para, para, para, lambda: f"# {para()[:30]}", lambda: f"```\n{para()}\n\n{para()}\n```"])() for _ in range(rng.randrange(1, 40))]
        texts.append(rng.choice(["", " "]) + "\n\n".join(parts) + rng.choice(["", " \n"]))
    df = spark.createDataFrame([(f"d/{n}.md", "t", x) for n, x in enumerate(texts)], "source_file string, title string, content string")
    plain = lambda s: counter(s)  # noqa: E731  # has no join
    for most, least in ((10, 4), (60, 20), (800, 50)):
        got = sorted(map(tuple, chunking.chunk_documents_with(df, counter, most, least).collect()))
        assert got == sorted(map(tuple, chunking.chunk_documents_with(df, plain, most, least).collect()))

    from docindex.helpers.sections import chunk

    long = "\n\n".join(para() for _ in range(100_000 // 100))
    began = time.process_time()
    assert len(chunk(long, 10**9, 0, counter)) == 1 and len(chunk(long, 800, 50, counter)) > 20
    assert time.process_time() - began < 3
