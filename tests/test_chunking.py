import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vectrail.functions import text as T
from vectrail.functions.text import ChunkOptions
from vectrail.operators.chunking import chunk, cut_segments, fold_text

SAMPLES = [
    "",
    "one. two. three",
    "intro text\n# Heading\nmore text",
    "a b c d e f g h i j",
    "first\n\nsecond paragraph\nstill second! yes? no.",
    "class A\n{\n    int x; int y;\n}\n\n/// <summary>\nvoid B()\n{ return; }\n",
    "a { color: red; }\n@media x {\n b { c: d; }\n}\n",
    "def f():\n    return 1. \n\n\nclass B:\n  pass\n",
    "caf\u00e9 \U0001F600 one.\u00a0two\r\nthree\n\n\n\u00a0# four ",
    "<h1>Title</h1>\n<p>One. Two.</p>\n  <h2>Next</h2>\n",
]


def words(text):
    return len(text.split())


@pytest.mark.parametrize(
    "text, breaks, wanted",
    [
        ("hello\nworld", ["\n"], ["hello\n", "world"]),
        ("one. two. three", [". "], ["one. ", "two. ", "three"]),
        ("hello\n\nworld", ["\n", "\n\n"], ["hello\n\n", "world"]),
        ("a---b---c", ["---"], ["a---", "b---", "c"]),
        ("hello\n", ["\n"], ["hello\n"]),
        ("a. . b", [". "], ["a. ", ". ", "b"]),
        ("", ["\n"], []),
    ],
)
def test_segments_of_any_list(text, breaks, wanted):
    assert cut_segments(text, breaks) == wanted


@settings(max_examples=300, deadline=None)
@given(st.text("ab.!?; \n{}#", max_size=40), st.sampled_from(sorted(T.BREAK_STRINGS)))
def test_segments_add_up(text, preset):
    assert "".join(cut_segments(text, T.BREAK_STRINGS[preset])) == text


@settings(max_examples=200, deadline=None)
@given(st.text("ab. \n#", max_size=60), st.integers(1, 6))
def test_chunks_add_up_and_keep_the_limit(text, most):
    segs = cut_segments(text, T.BREAK_STRINGS["markdown"])
    found = fold_text(segs, ChunkOptions(most), words)
    assert "".join(found) == text
    assert all(words(c) <= most or c in segs for c in found)


@pytest.mark.parametrize("preset", sorted(T.BREAK_STRINGS))
@pytest.mark.parametrize("most", [1, 3, 10])
def test_both_forms_agree(spark, preset, most):
    docs = spark.createDataFrame(list(enumerate([*SAMPLES, None])), "doc_id int, text string")
    options = ChunkOptions(most, preset, preset)
    native = chunk(docs, options)
    found = {}
    for r in native.collect():
        found.setdefault(r["doc_id"], {})[r["chunk_index"]] = r["chunk"]
    for i, text in enumerate(SAMPLES):
        wanted = fold_text(cut_segments(text, options.breaks), options, lambda t: len([w for w in __import__("re").findall(r"[^ \t\n\x0b\f\r]+", t)]))
        assert [found.get(i, {})[k] for k in sorted(found.get(i, {}))] == wanted
    assert len(SAMPLES) not in found


def test_stop_signals_start_chunks(spark):
    docs = spark.createDataFrame([(1, "intro text\n# Heading\nmore text")], "doc_id int, text string")
    found = [r["chunk"] for r in chunk(docs, ChunkOptions(100)).orderBy("chunk_index").collect()]
    assert found == ["intro text\n", "# Heading\nmore text"]
    signals = spark.createDataFrame([("\u00a0 # x",), ("x # y",), ("",)], "s string").select(T.has_stop_signal(F.col("s"), ["# ", ""])).collect()
    assert [r[0] for r in signals] == [True, False, False]


def test_counter_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "aa, bb, cc, dd")], "doc_id int, text string")
    found = chunk(docs, ChunkOptions(8, (", ",), ()), counter=len).orderBy("chunk_index").collect()
    assert [r["chunk"] for r in found] == ["aa, bb, ", "cc, dd"]


def test_options():
    assert ChunkOptions().max_tokens == 300 and len(ChunkOptions().breaks) == 16 and len(ChunkOptions().stops) == 8
    assert {k: (len(T.BREAK_STRINGS[k]), len(T.STOP_SIGNALS[k])) for k in T.BREAK_STRINGS} == {
        "markdown": (16, 8), "plain": (5, 0), "csharp": (5, 1), "javascript": (5, 1), "html": (3, 3), "css": (4, 4), "python": (3, 3),
    }
    for bad in (dict(max_tokens=0), dict(break_strings=())):
        with pytest.raises(ValueError):
            ChunkOptions(**bad)


def test_both_default_counters_agree(spark):
    """White space that only some counters know must not cut a text differently."""
    texts = ["a\u00a0b\u2003c d. e\u00a0f. g h\x1ci. ", "one\u00a0two. three four. five"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    preset = chunk(docs, ChunkOptions(3, "plain", "plain")).collect()
    listed = chunk(docs, ChunkOptions(3, tuple(T.BREAK_STRINGS["plain"]), ())).collect()
    assert sorted(preset) == sorted(listed)


def test_long_text_without_breaks():
    import time

    began = time.time()
    assert cut_segments("a" * 400_000, ["\n", ". "]) == ["a" * 400_000]
    assert time.time() - began < 5
