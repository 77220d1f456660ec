"""Passages of short lines in different contexts, against brute force."""

import pytest

from tempora.llm import lines


@pytest.mark.parametrize("k", [2, 3, 4, 6])
def test_passages_of_short_lines_go_in_any_context(spark, k):
    passage = lambda n: [" ".join(f"p{k}x{n}x{i}w{j}" for j in range(30)) for i in range(k)]
    around = lambda n, d: [f"own line {d} {n} {i}" for i in range(3)]
    rows = [(2 * n + d, "\n".join([*around(n, d), *passage(n), *around(n, d + 2)])) for n in range(30) for d in (0, 1)]
    got = {r["row"]["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n in range(30):
        assert got[2 * n]["new_text"] == rows[2 * n][1] and got[2 * n]["n_removed"] == 0
        assert got[2 * n + 1]["new_text"] == "\n".join([*around(n, 1), *around(n, 3)]) and got[2 * n + 1]["n_removed"] > 0


def test_pairs_of_lines_keep_their_first_place(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(0, f"{b}\n{c}"), (1, f"{a}\n{b}\n{c}"), (2, f"{a}\n{b}"), (3, f"{a}\n{a}\n{a}\n{a}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # no chunk of two lines: only runs of pairs are at work
    got = {r["row"]["doc_id"]: r["new_text"] for r in lines.dedup_lines(df, mean_lines=1).collect()}
    assert got == {0: f"{b}\n{c}", 1: f"{a}\n{b}", 2: "", 3: f"{a}\n{a}"}
