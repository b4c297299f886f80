"""The pipeline's near-copy stage against all pairs by similarity."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from tests.llm.test_operators import prose
from tracelode.llm import near_copies


def exact(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def brute(rows):
    """The least doc_id of each row's component of pairs with a Jaccard similarity of 0.8 or more."""
    sets, group = [exact(t) for _, t in rows], list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        s, t = sets[a], sets[b]
        if (not (s | t) or 5 * len(s & t) >= 4 * len(s | t)) and group[a] != group[b]:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return sorted({min(k for (k, _), h in zip(rows, group) if h == g) for g in group})


def edited(text, seed, n):
    dice, words = random.Random(seed), text.split()
    for at in dice.sample(range(len(words)), n):
        words[at] = f"w{seed}x{at}"
    return " ".join(words)


def test_edited_copies_go(spark):
    """Near copies of 200 words, of equal words in other spacing, and empty ones."""
    rows = [(k, prose(5000 + k, 200)) for k in range(8)]
    rows += [(100 + 10 * k + n, edited(rows[k][1], 10 * k + n, n)) for k in range(8) for n in (1, 2, 3, 6, 7)]
    rows += [(300, ""), (301, None), (302, "two words"), (303, "two words "), (304, rows[0][1])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    wanted = brute(rows)
    got = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near copies"](spark, table, "").collect())
    assert got == wanted and len(wanted) < 35


def longer(n, seed, more):
    """Two texts of n and n + more distinct shingles, all of the first in the second."""
    words = [f"w{seed}x{k}" for k in range(n + 4 + more)]
    return " ".join(words[: n + 4]), " ".join(words)


def test_recall_by_size(spark):
    """No pair at 0.8 or a little more is lost among sets of 1 to 60 shingles, hardly any among larger ones; none below it is found."""
    rows, near, apart = [], {}, []
    for n in [*range(1, 61), *[200] * 100, *[1000] * 20]:
        at = 10 * len(rows)
        one, two = longer(n, at, n // 4)
        near[at + 1] = n
        rows += [(at, one), (at + 1, two if n >= 4 else one.upper())]
        if n >= 8:
            apart.append(at + 2)
            rows.append((at + 2, " ".join(f"v{at}x{k}" for k in range(3)) + " " + longer(n, at, n // 4 + 1)[1]))
    kept = {r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()}
    lost = [near[k] for k in near if k in kept]
    assert all(k % 10 or k in kept for k, _ in rows) and not [n for n in lost if n <= 50] and len(lost) <= 3
    sets = dict(rows)
    assert all(k in kept for k in apart if max(len(exact(sets[k]) & exact(sets[j])) / len(exact(sets[k]) | exact(sets[j])) for j in (k - 1, k - 2)) < 0.8)


def test_edits_of_short_texts(spark):
    """Texts of 1 to 30 words with words changed, dropped and added, against all pairs."""
    rows = []
    for k in range(120):
        words, dice = prose(k, 1 + k % 30).split(), random.Random(k)
        for j in range(4):
            copy = list(words)
            if j:
                at = dice.choice((0, len(copy) - 1, dice.randrange(len(copy))))
                copy[at : at + 1] = [[], [copy[at], f"n{j}"], [f"c{j}"]][j - 1]
            rows.append((10 * k + j, " ".join(copy)))
    got = sorted(r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect())
    assert got == brute(rows)


def test_common_line_in_short_texts(spark):
    """Short texts that share a line and nothing else are no copies; prefixes begin with what is rare."""
    line = "this very line stands in all of them again"
    rows = [(k, f"{line} {prose(k, 6)}") for k in range(150)] + [(900, line), (901, line + " x"), (902, line.title())]
    got = sorted(r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect())
    assert got == brute(rows)


def test_all_pairs_of_a_value_are_compared(spark):
    """Chains: neighbours are near copies, the ends are not, so most have no link to the least of their segments."""
    words, rows = prose(1, 300).split(), []
    for k in range(40):
        words = list(words)
        for j in range(3):
            words[(37 * k + 101 * j) % 300] = f"c{k}x{j}"
        rows.append((k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert [r.doc_id for r in near_copies.one_of_each(table).collect()] == brute(rows) == [0]


def test_rows_of_edges(spark):
    texts = [(5, "a b c d e f"), (5, "q r s t u v"), (3, "q r s t u v"), (None, "q r s t u v"), (None, "k l m n o p"), (None, "k l m n o p"), (7, "k j i h g f"), (7, "k j i h g f")]
    got = near_copies.one_of_each(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(5, "a b c d e f"), (3, "q r s t u v"), (None, "k l m n o p"), (7, "k j i h g f")]))
    assert near_copies.one_of_each(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
