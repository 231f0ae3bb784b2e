import random
import re

import pytest

from colloquy.llm import op5_units as op
from colloquy.llm.common import Staging
from tests.oracle import same

LINES = {"unit": "line", "context": 1, "run": 1}
L = ["one two three four five", "a line of six words here", "short one", "the last of the long lines"]


def words(n, seed):
    return " ".join(f"{seed}w{i}" for i in range(n))


def brute(rows, unit="sentence", context=8, run=25):
    """(kept, removed spans) of each (doc_id, text), in the order given; ids are distinct and not null."""
    pattern = {"sentence": r"[^\n]*?(?:[.!?;:,][ \t]+|[。！？；，]|\n)|[^\n]+", "line": r"[^\n]*\n|[^\n]+"}[unit]
    seen, out = set(), {}
    for doc, text in sorted(rows):
        pieces = [(m.start(), m.end(), " ".join(m[0].lower().split())) for m in re.finditer(pattern, text or "")]
        units = [(a, b, n, max(len(n.split(" ")), len(n.encode()) // 12)) for a, b, n in pieces if n]
        late = set()
        for i in range(len(units)):
            j = i
            while j < len(units) and sum(u[3] for u in units[i:j]) < context:
                j += 1
            window = tuple(u[2] for u in units[i:j])
            if window in seen:
                late |= {*range(i, j)}
            seen.add(window)
        spans, i = [], 0
        while i < len(units):
            j = i
            while j in late:
                j += 1
            if j > i and sum(u[3] for u in units[i:j]) >= run:
                spans.append((units[i][0], units[j - 1][1]))
            i = max(j, i + 1)
        kept = text
        for a, b in reversed(spans):
            kept = kept[:a] + kept[b:]
        out[doc] = (kept, spans)
    return [out[d] for d, _ in rows]


def run(spark, rows, parts=1, **kw):
    staging = Staging(spark, "test-units")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).selectExpr("*", "1 as pos", "'x' as unit", "2 as shard", "array(3) as late", "'r' as rows")
    out = op.dedup(df, staging, **kw)
    assert out.columns[:7] == df.columns
    got = [(r.doc_id, r.kept, r.n_units, r.n_removed, [(s.start, s.end) for s in r.spans]) for r in out.collect()]
    staging.drop()
    return sorted(got, key=repr)


def test_earliest_line_stays_with_offsets(spark):
    rows = [
        (2, "\n".join([L[0], "own words of document number two", L[1].upper(), L[2]])),
        (1, "\n".join([L[1], L[2], L[0], L[0] + "  "])),
        (3, None),
        (4, ""),
        (None, L[3] + "\n" + L[0]),
        (5, "\n\n" + L[3]),
        (6, " \n\t\n"),
    ]
    got = run(spark, rows, **LINES)
    assert got == sorted(
        [
            (1, "\n".join([L[1], L[2], L[0]]) + "\n", 4, 1, [(59, 84)]),
            (2, "own words of document number two\n", 4, 3, [(0, 24), (57, 91)]),
            (3, None, 0, 0, []),
            (4, "", 0, 0, []),
            (None, "", 2, 2, [(0, 50)]),
            (5, "\n\n" + L[3], 1, 0, []),
            (6, " \n\t\n", 0, 0, []),
        ],
        key=repr,
    )


def test_hot_line_and_one_id_with_two_texts(spark):
    rows = [(i, L[0] + "\n" + f"unique text number {i} of this document") for i in range(400)] + [(7, L[3]), (8, L[3])]
    got = run(spark, rows, parts=20, **LINES)
    assert sum(r[3] for r in got) == 400
    assert (7, L[3], 1, 0, []) in got and (8, "", 1, 1, [(0, 26)]) in got


def test_of_repeated_rows_one_stays(spark):
    for parts in (1, 4):
        got = run(spark, [(5, words(60, "a"))] * 3 + [(None, words(60, "b"))] * 2, parts=parts)
        assert [r[1] for r in got].count(words(60, "a")) == 1 and [r[1] for r in got].count(words(60, "b")) == 1
        assert [r[1] for r in got].count("") == 3


def test_paragraphs_and_empty(spark):
    two = L[0] + "\n" + L[1]
    assert run(spark, [(1, two + "\n\n" + L[3]), (2, L[3] + "\n\n" + two)], unit="paragraph", context=1, run=1)[1][:2] == (2, "")
    assert run(spark, []) == []


def test_a_passage_inside_lines_goes_and_common_lines_stay(spark):
    passage = ", ".join(words(6, f"p{i}") for i in range(9)).capitalize() + "."
    licence = "All rights reserved. " + words(15, "licence")
    rows = [
        (1, f"{words(30, 'a')} {passage} {words(20, 'b')}\n{licence}"),
        (2, f"{words(12, 'c')}. {words(5, 'd')} {passage} {words(4, 'e')}.\n{licence}"),
        (3, f"{words(3, 'h')}\n{passage}\n{words(9, 'f')}\n{licence}"),
        (4, f"{words(20, 'g')}\n{licence}"),
    ]
    got = run(spark, rows)
    assert [(r[1], r[4]) for r in got] == brute(rows)
    assert [r[3] > 0 for r in got] == [False, True, True, False]
    # only the clause that another text runs into stays
    assert got[1][1] == f"{words(12, 'c')}. {words(5, 'd')} {words(6, 'p0').capitalize()}, {words(4, 'e')}.\n{licence}"
    assert got[2][1] == f"{words(3, 'h')}\n{words(6, 'p0').capitalize()}, {words(9, 'f')}\n{licence}"


def test_scripts_without_spaces(spark):
    passage = "".join(chr(0x4E00 + i) for i in range(120))
    rows = [(1, f"甲乙丙。{passage}。丁戊"), (2, f"己庚辛。{passage}。壬癸")]
    assert [r[1] for r in run(spark, rows)] == [rows[0][1], "己庚辛。壬癸"]


@pytest.mark.parametrize(("unit", "context", "least"), [("sentence", 8, 25), ("sentence", 3, 6), ("line", 1, 1), ("line", 4, 9)])
def test_equals_brute_force(spark, unit, context, least):
    rng, rows = random.Random(context), []
    for i in range(120):
        parts = []
        for _ in range(rng.randrange(12)):
            parts.append(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) + rng.choice([". ", ", ", "\n", " \n\n", ".", "! \t"]))
            if rng.random() < 0.2 and rows:
                other = rng.choice(rows)[1]
                a = rng.randrange(len(other) + 1)
                parts.append(other[a : a + rng.randrange(80)])
        rows.append((i, "".join(parts)))
    got = {r[0]: (r[1], r[4]) for r in run(spark, rows, parts=5, unit=unit, context=context, run=least)}
    assert [got[d] for d, _ in rows] == brute(rows, unit, context, least)


def test_long_text(spark):
    text = ". ".join(words(7, i) for i in range(60_000))
    got = run(spark, [(1, text), (2, "x. " + text)])
    assert got[0][3] == 0 and got[1][1] == "x. " and got[1][2] == 60_001


def test_query_equals_sql(spark):
    assert sum(r[4] for r in same(spark, "op5_substring_dedup")[1]) > 0


def test_every_line_takes_short_ones_and_those_without_spaces(spark):
    rows = [(1, "Short one\n東京は日本の首都です。\n\nx"), (2, "東京は日本の首都です。\n \n\nshort  ONE\nown")]
    assert run(spark, rows, **LINES) == [(1, rows[0][1], 3, 0, []), (2, "own", 3, 2, [(0, 26)])]


def test_every_line_equals_sql(spark):
    every, long = same(spark, "op5_every_line"), same(spark, "op5_substring_dedup")
    at = every[0].index("n_removed")
    assert sum(r[at] for r in every[1]) > 0 and sum(r[at] for r in long[1]) > 0
