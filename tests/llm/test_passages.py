"""Repeated passages of 50 words against brute force."""

import random

from assayer.llm import paragraphs
from tests.llm.test_pairs import WORD, linked, lower, paragraph_sets


def brute(rows, length=50):
    """Each document's words left, after repeated paragraphs and every run of 50 words that stands before."""
    sets, _ = paragraph_sets(rows)
    u, seen, left = linked(sets), {}, {}
    for d, t in sorted(rows):
        found = list(WORD.finditer(t))
        words = [lower(m[0]) for m in found]
        end = [k for k, m in enumerate(found) if k + 1 == len(found) or "\n" in t[m.end() : found[k + 1].start()]]
        part, gone = [sum(e < k for e in end) for k in range(len(words))], set()
        for i in range(len(words) - length + 1):
            at = seen.setdefault(tuple(words[i : i + length]), (d, i, part[i]))
            if at[0] != d or i >= at[1] + length and part[i] != at[2]:
                gone.update(range(i, i + length))
        gone.update(k for k in range(len(words)) if (d, part[k]) in sets and u.find((d, part[k])) != (d, part[k]))
        left[d] = [m[0] for k, m in enumerate(found) if k not in gone]
    return left


def test_passages_of_short_lines_and_cut_sentences(spark):
    rng = random.Random(7)
    own = lambda n, end=0.15: [f"{'Ab'[rng.randint(0, 1)]}{rng.randint(0, 5000)}{'.' if rng.random() < end else ''}" for _ in range(n)]
    menu = "\n".join(" ".join(own(3, 0)) for _ in range(30))
    prose, said = " ".join(own(70)), " ".join(own(60, 0.5))
    rows = [(1, menu), (2, prose), (3, said), (4, menu.upper()), (5, "  " + said + " \n"), (6, " ".join(own(49))), (9, "tick " * 300), (8, "\n".join(["top", menu.replace("b", "c"), "middle", menu.replace("b", "c")]))]
    for k in range(20):
        part = rng.choice([menu, prose, said, menu])
        rows.append((10 + k, " ".join(own(rng.randint(0, 30))) + rng.choice([" ", "\n"]) + part + rng.choice([" ", "\n"]) + " ".join(own(rng.randint(0, 30)))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    out = {r.row.doc_id: r for r in paragraphs.stripped(df).collect()}
    assert {d: WORD.findall(r.kept) for d, r in out.items()} == want
    assert out[4].kept == "" and out[5].kept == "" and out[1].kept == menu
    assert {d: r.n_removed_words for d, r in out.items()} == {d: len(WORD.findall(t)) - len(want[d]) for d, t in rows}


def test_passages_of_rows_that_repeat_an_id(spark):
    a, b = ("\n".join(f"{x}{i} {x}" for i in range(30)) for x in "ab")
    df = spark.createDataFrame([(1, a), (2, "x\n" + a), (2, b), (2, b), (None, a), (3, None)], "doc_id long, text string")
    found = sorted((str(r.row.doc_id), r.kept) for r in paragraphs.stripped(df).collect())
    assert found == sorted([("1", a), ("2", "x\n"), ("2", b), ("2", b), ("None", a), ("3", None)], key=str)
