import random

import pytest

from vellumine.llm.pieces import _Range, apply_summary, fence_lines, fence_summary, split_files, split_oversized, step_fence

ALPHABET = ["word ", "Satz. ", "\n", "\n\n", "é", "e\u0301", "👨‍👩‍👧", "🇮🇪", "文字。", "| a | b |\n", "```\n", "~~~~\n", "```` x\n", "# Head\n", "x" * 50]


def check(text: str, heading: str, rows: list, base: int, limit: int, overlap: int) -> None:
    raw, at = text.encode(), 0
    for k, r in enumerate(sorted(rows, key=lambda r: r["piece"])):
        a, z = r["byte_start"] - base, r["byte_end"] - base
        assert r["piece"] == k and raw[a:z].decode() == r["text"]
        assert len(r["text"].encode()) + len(r["heading_path"].encode()) <= limit
        assert 0 <= at - a <= overlap and z > at
        at = z
    assert at == len(raw)


@pytest.mark.parametrize("limit,overlap,step", [(4096, 256, 65_536), (300, 40, 700), (200, 0, 450)])
def test_pieces_cover_all_bytes(spark, limit, overlap, step):
    rng = random.Random(limit)
    rows = [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.choice([50, 900, 4000]))), rng.choice(["", "A > B", "H" * 150]), 100 * i) for i in range(12)]
    d = spark.createDataFrame(rows, "id long, text string, heading_path string, byte_start long").selectExpr("*", "1 as piece", "2 as r")
    out = split_oversized(d, limit=limit, overlap=overlap, step=step).collect()
    for i, text, heading, base in rows:
        mine = [r for r in out if r["id"] == i]
        assert bool(mine) == (len(text.encode()) + len(heading.encode()) > limit)
        if mine:
            check(text, heading, mine, base, limit, overlap)


def test_natural_boundaries_and_clusters(spark):
    para = ("A sentence of some length stands here. " * 12).strip() + "\n\n"
    d = spark.createDataFrame([(1, para * 30, "T", 0), (2, "👨‍👩‍👧" * 900, "", 0)], "id long, text string, heading_path string, byte_start long")
    out = split_oversized(d).collect()
    first = sorted((r for r in out if r["id"] == 1), key=lambda r: r["piece"])
    assert all(r["text"].endswith("\n\n") for r in first)
    assert all(len(r["text"].encode()) % len("👨‍👩‍👧".encode()) == 0 for r in out if r["id"] == 2)


def test_odd_rows(spark):
    big = "word " * 2000
    rows = [(1, None, None, 0), (2, "", "x", 0), (None, big, "x", None), (3, big, "x", 0), (3, big, "x", 0), (4, "short", "H > " * 2000, 5), (5, None, "H" * 9000, 0), (6, "\u0301" * 6000, "", 0)]
    d = spark.createDataFrame(rows, "id long, text string, heading_path string, byte_start long")
    out = split_oversized(d).collect()
    assert {r["id"] for r in out} == {None, 3, 4, 5, 6}
    assert all(len(r["text"].encode()) + len(r["heading_path"].encode()) <= 4096 for r in out)
    assert split_oversized(d.limit(0)).count() == 0


def test_files(spark, tmp_path):
    text = "".join(f"Line {i} of the file.\n" + ("\n" if i % 9 == 0 else "") for i in range(9000))
    p = tmp_path / "a.md"
    p.write_text(text)
    f = spark.createDataFrame([(str(p), p.stat().st_size)], "path string, size long")
    out = split_files(spark, f, step=20_000).collect()
    check(text, "", out, 0, 4096, 256)


def test_fences_are_stitched_like_one_pass():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["a\n", "```\n", "````\n", "~~~\n", "~~~~~\n", "``` py\n", "~~~ `x`\n", "``` a`b\n", "    ```\n", "x ```\n"]) for _ in range(40)).encode()
        lines = fence_lines(text, 0, 0, len(text))
        state, at = None, {}
        for f in lines:
            at[f.at] = state
            state = step_fence(state, f)
        edges = sorted(rng.sample(range(len(text)), 3))
        got = None
        for a, z in zip([0, *edges], [*edges, len(text)]):
            part = fence_lines(text, 0, a, z)
            assert not part or at[part[0].at] == got
            got = apply_summary(got, fence_summary(part))
        assert got == state


def test_other_fence_inside_code_and_open_fence():
    prose = "One line of prose.\n\nAnother one.\n\n"
    text = f"```\ncode\n~~~\nmore\n\ncode\n```\n{prose}"
    r = _Range(text.encode(), 0, None, 0)
    level = lambda s: int(r.level[text.index(s)])
    assert level("Another") == 6 and level("code\n```\nOne") == 3
