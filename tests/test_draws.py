"""Draws of the reassignment null against a plain version, and how many there are."""

import hashlib

from airgrid.plans import resampling as rs


def line_of(spark, sizes, piece):
    out = []
    for kind in ("start", "end"):
        before = 0
        for col, m in enumerate(sizes):
            out += [(kind, 0, col, m, before, p) for p in range(before // piece, (before + m - 1) // piece + 1)]
            before += m
    return spark.createDataFrame(out, "kind string, row int, col int, m long, before long, piece long")


def test_drawn_cells_equal_all_draws(spark, monkeypatch):
    monkeypatch.setattr(rs, "FIRST_DRAWS", 16)
    sizes, n = [150, 1, 100, 1, 48], 3
    total = sum(sizes)
    got = {tuple(r) for r in rs._drawn_cells(line_of(spark, sizes, 7), n, total, 7, 42).collect()}
    owner = [c for c, m in enumerate(sizes) for _ in range(m)]
    want = {(k, i, 0, owner[int(hashlib.md5(f"42|{k}|{i}|{j}".encode()).hexdigest()[:15], 16) % total])
            for k in ("start", "end") for i in range(n) for j in range(total)}
    assert got == want and len(want) < 2 * n * len(sizes)  # some of the rare cells are never hit


def test_draws_end_once_every_cell_is_hit(spark, monkeypatch):
    made = []
    monkeypatch.setattr(rs, "draw_grid", lambda s, n, size, make=rs.draw_grid: made.append(n * size) or make(s, n, size))
    total = 40_000_000
    got = rs._drawn_cells(line_of(spark, [total // 4] * 4, total // 16), 1, total, total // 16, 42)
    assert got.count() == 8 and sum(made) == 2 * rs.FIRST_DRAWS
