import pytest

from vellumine.functions.chunking import LARGEST, SMALLEST, blocks, chunk, chunk_texts, hard_split
from vellumine.functions.text import normalize, normalize_bytes, preview, preview_of
from pyspark.sql import functions as F


def para(n: int) -> str:
    return ("word " * n)[: n - 1].strip() + "\n"


def paths(text: str, ceiling: int = 0) -> list[str]:
    return [" > ".join(p.path) for p in chunk(text, ceiling)]


def test_breadcrumbs():
    body = para(300)
    text = "".join(f"{h}\n{body}\n" for h in ("# A", "## B", "### C", "## D", "# E"))
    assert paths(text) == ["A", "A > B", "A > B > C", "A > D", "E"]


@pytest.mark.parametrize("text", ["", "\n \n", "---\ntitle: x\n---\n", "---\na: b\n...\n\n"])
def test_nothing_to_chunk(text):
    assert chunk(text) == []


def test_unclosed_front_matter_is_content():
    assert len(chunk("---\ntitle: x\n")) == 1


def test_tiny_sections_merge_into_a_neighbour():
    text = f"# Top\n## A\n{para(100)}\n## B\n{para(500)}\n"
    assert paths(text) == ["Top"]
    two = f"# Top\n## A\n{para(60)}\n## B\n{para(60)}\n"
    assert paths(two) == ["Top > A", "Top > B"]
    full = f"# Top\n## A\n{para(100)}\n## B\n{para(LARGEST - 20)}\n"
    assert paths(full) == ["Top > A", "Top > B"]


def test_longer_shared_path_wins():
    text = f"# One\n{para(400)}\n# Two\n## A\n{para(80)}\n## B\n{para(400)}\n"
    assert paths(text) == ["One", "Two"]


def test_preamble_is_never_merged():
    assert paths(f"{para(50)}\n# H\n{para(400)}\n") == ["", "H"]


def test_ceiling_splits_and_warns():
    got = chunk("# H\n\n" + "x" * 3000, 200)
    assert all(p.end - p.start <= 200 * 4 - 256 - 1 for p in got) and all(p.warning for p in got)
    assert sum(p.end - p.start for p in got) == 3000


def test_headings_and_fences():
    kinds = [(b.level, b.title) for b in blocks(b"## C#\n# X ##\n#no\n # no\n####### no\n")]
    assert kinds == [(2, "C#"), (1, "X"), (0, "")]
    assert len(blocks(b"```\n# not a heading\n~~~\n```\ntext\n")) == 2
    assert len(blocks(b"````\n```\nstill\n")) == 1  # unclosed: to the end
    assert len(blocks(b"a | b\n---|---\n1 | 2\n\npara\n")) == 2
    assert len(blocks(b"a | b\nno delimiter\n")) == 1


def test_overlap_is_block_aligned():
    text = "# H\n\n" + "\n".join(para(200) + "\n" for _ in range(40))
    got = chunk(text)
    assert len(got) > 2
    for a, b in zip(got, got[1:]):
        assert 0 <= a.end - b.start <= 256 and b.start > a.start


@pytest.mark.parametrize("text,most,want", [("ab\n\ncd ef", 6, [(0, 4), (4, 9)]), ("ab\ncd ef", 6, [(0, 3), (3, 8)]), ("ab cd", 4, [(0, 3), (3, 5)]), ("éé", 3, [(0, 2), (2, 4)]), ("é", 1, [(0, 2)])])
def test_hard_split(text, most, want):
    assert hard_split(text.encode(), 0, len(text.encode()), most) == want


def test_invariants_on_random_documents():
    import random

    rng = random.Random(9)
    parts = ["# A\n", "## B\n", "### C é\n", "```\ncode\n", "```\n", "| a | b |\n|---|---|\n| 1 | 2 |\n", "\n", para(90), para(700), "é" * 300 + "\n", para(5000)]
    for ceiling in (0, 128, 2048):
        for _ in range(60):
            text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
            raw = text.encode()
            got = chunk(text, ceiling)
            for p in got:
                raw[p.start : p.end].decode()
                if ceiling:
                    assert p.end - p.start <= max(64, ceiling * 4 - 256 - len(" > ".join(p.path).encode()))
            assert all(a.start < b.start for a, b in zip(got, got[1:]))
            covered = bytearray(len(raw))
            for p in got:
                covered[p.start : p.end] = b"\1" * (p.end - p.start)
            assert all(covered[b.start : b.end].count(1) == b.end - b.start for b in blocks(raw) if not b.level)


def test_chunk_table(spark):
    d = spark.createDataFrame([("a", "# T\n\n" + para(300)), ("b", None), ("c", ""), (None, para(300))], "content_hash string, text string")
    rows = chunk_texts(d.withColumn("ordinal", F.lit("clash"))).collect()
    assert sorted((r["content_hash"] or "", r["ordinal"], r["heading_path"]) for r in rows) == [("", 0, ""), ("a", 0, "T")]
    assert chunk_texts(d.limit(0)).count() == 0 and SMALLEST == 256


ENCODED = [
    ("é".encode(), "é"), (b"\xef\xbb\xbfx", "x"), (b"\xff\xfe" + "naïve".encode("utf-16-le"), "naïve"), (b"\xfe\xff" + "—".encode("utf-16-be"), "—"), (b"", ""),
    (b"\xff\xfe\x00\x00a", None), (b"\xff\xfea", None), (b"\xff\xfe\x00\xd8", None), (b"\xff", None), (None, None),
]


def test_normalize(spark):
    assert [normalize(raw)[0] for raw, _ in ENCODED] == [t for _, t in ENCODED]
    d = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(ENCODED)], "i int, raw binary")
    got = {r["i"]: r for r in normalize_bytes(d).collect()}
    assert all((got[i]["text"], got[i]["error"] is None) == (t, t is not None) for i, (_, t) in enumerate(ENCODED))


PREVIEWS = [("", ""), ("  a \n b  ", "a b"), ("abcdef", "abcde…"), ("abcde", "abcde"), ("abcd ef", "abcd…"), ("a\x1bb", "ab"), ("日本語日本語", "日本語日本…"), ("abcde   ", "abcde"), ("\x07", ""), ("a \tb", "a b")]


def test_preview(spark):
    assert [preview_of(t, 5) for t, _ in PREVIEWS] == [w for _, w in PREVIEWS]
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PREVIEWS)], "i int, t string")
    assert [r["p"] for r in d.select("i", preview(F.col("t"), 5).alias("p")).orderBy("i").collect()] == [w for _, w in PREVIEWS]
