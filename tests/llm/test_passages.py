"""Passages that are no line of their own."""

from __future__ import annotations

import random

from lattice.llm import paragraphs


def test_passages_go_wherever_the_lines_break(spark):
    rng = random.Random(11)
    own = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(n)]
    passages = [own(n) for n in (51, 60, 120)]
    docs = []
    for k in range(24):
        w = [x.upper() if k % 2 else x for x in passages[k % 3]]
        body = "\n".join(" ".join(w[i : i + 7]) for i in range(0, len(w), 7)) if k % 4 == 0 else " ".join(w)  # short lines, or inside a line
        docs.append((k, " ".join(own(70)) + " " + body + " " + " ".join(own(80))))
    docs += [(None, docs[0][1] + " end"), (40, "\n".join(" ".join(passages[1][i : i + 9]) for i in range(0, 45, 9))), (41, "again and again " * 90)]
    rows = {r["doc_id"]: r for r in paragraphs.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    for k in range(3, 24):
        p, kept = passages[k % 3], rows[k]["kept"].lower().split()
        left = [w for w in p if w in set(kept)]
        # A line of it may be kept in a later document than the whole, which then loses it to the first.
        assert len(left) < paragraphs.REACH * 2 and any(d < k and d % 3 == k % 3 for d in rows[k]["kept_in"]), (k, len(left))
        assert rows[k]["n_long"] >= paragraphs.UNIT or k % 4 == 0
        assert all(w in kept for w in docs[k][1].lower().split() if w not in p)
    for k in range(3):
        assert rows[k]["kept"] == docs[k][1] and not rows[k]["cut"]
    # Text that repeats itself keeps its first unit.
    assert paragraphs.UNIT <= len(rows[41]["kept"].split()) < paragraphs.UNIT + 2 * paragraphs.REACH
