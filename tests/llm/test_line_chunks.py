from __future__ import annotations

import hashlib
import random
from collections import Counter

from helpers import awkward_documents, document_table
from pyspark.sql import functions as F
from tidemark.llm import line_chunks as lc


def marks(line: str) -> str:
    return hashlib.md5(line.encode()).hexdigest()


def chunks(text: str) -> list[tuple[int, int]]:
    """First and last line of every chunk, from 0."""
    h = [int(marks(x)[:8], 16) for x in text.split("\n")]
    r = [(lc.FACTOR * a + b) % lc.MODULUS for a, b in zip(h, h[1:])]
    ends = [i for i in range(1, len(h) - 2) if r[i] < r[i - 1] and r[i] <= r[i + 1]] + [len(h) - 1]
    return list(zip([0, *[e + 1 for e in ends]], ends))


def places(rows):
    """Every chunk and pair of lines of the distinct documents, the earliest place first."""
    docs = sorted({(i is not None, i or 0, marks(t), i, t) for i, t in rows if t is not None})
    found: dict = {}
    for _, _, _, doc, text in docs:
        lines = text.split("\n")
        spans = [(a, b, True) for a, b in chunks(text) if b > a] + [(i, i + 1, False) for i in range(len(lines) - 1)]
        for a, b, chunk in sorted(spans):
            found.setdefault((chunk, tuple(lines[a : b + 1])), []).append((doc, text, a, b))
    return found


def removed(rows):
    later: dict = {}
    for (chunk, _), occurrences in places(rows).items():
        for doc, text, a, b in occurrences[1:]:
            later.setdefault((doc, text), []).append((a, b, chunk))
    gone: dict = {}
    for key, spans in later.items():
        pairs = sorted(a for a, _, chunk in spans if not chunk)
        starts = {a for a, _, chunk in spans if chunk}
        run: list[int] = []
        for a in [*pairs, None]:
            if run and (a is None or a > run[-1] + 1):
                if starts & set(run) or len(run) + 1 >= lc.LEAST_RUN:
                    gone.setdefault(key, set()).update(range(run[0], run[-1] + 2))
                run = []
            run.append(a)
    return gone


def expected(rows):
    gone = removed(rows)
    return sorted(((doc, None if text is None else "\n".join(
        line for i, line in enumerate(text.split("\n")) if i not in gone.get((doc, text), ()))) for doc, text in rows), key=repr)


def passages():
    rng = random.Random(2)
    lines = [f"line {i} " + "x" * (i % 7) for i in range(60)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    shared = "\n".join(lines[:20])
    rows += [(100 + i, f"own {i}\n{shared}\nend {i}") for i in range(20)]
    rows += [(200, "\n".join(["same"] * 400)), (201, "\n" * 50), (202, "")]
    return rows


def test_agrees_with_brute_force(spark):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lc.dedup_line_chunks(df, "doc_id", "text").collect()
    assert sorted([tuple(r) for r in got], key=repr) == expected(rows)


def test_chunks_have_two_lines_and_move_with_the_content():
    lines = [f"text of line {i}" for i in range(200)]
    plain = {tuple(lines[a : b + 1]) for a, b in chunks("\n".join(lines))}
    other = ["inserted", *lines]
    moved = {tuple(other[a : b + 1]) for a, b in chunks("\n".join(other))}
    assert len(plain - moved) <= 2
    assert all(b > a for n in range(2, 60) for a, b in chunks("\n".join(lines[:n])))


def test_whole_passages_go_and_nothing_is_lost(spark):
    rng = random.Random(8)
    passage = [[f"passage {p} line {i}" for i in range(8)] for p in range(30)]
    rows = []
    for i in range(200):
        body = [f"own {i} {j}" for j in range(rng.randint(1, 6))]
        at = rng.randrange(len(body) + 1)
        rows.append((i, "\n".join([*body[:at], *passage[i % 30], *body[at:]])))
    got = {r["doc_id"]: r["text"].split("\n") for r in lc.dedup_line_chunks(
        spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    left = Counter(x for lines in got.values() for x in lines)
    before = Counter(x for _, t in rows for x in t.split("\n"))
    assert set(left) == set(before)
    repeats = sum(n - 1 for n in before.values())
    assert sum(before.values()) - sum(left.values()) >= 0.9 * repeats


def test_a_hash_with_two_lines_removes_nothing(spark):
    bodies = spark.createDataFrame([("a\nb",), ("c\nb",)], "body string")
    same = lambda line: F.unhex(F.md5(F.lit(line)))
    pairs = bodies.select(F.concat(same("a"), same("b")).alias("h"))
    assert lc._ambiguous(bodies, pairs).count() == 0


def test_awkward_rows_and_clashing_names(spark):
    rows = awkward_documents()
    docs = document_table(spark, rows)
    for name in ("__gone", "__rid", "__chunks", "n_lines", "runs", "row", "body", "mark", "marks", "rid", "first", "h"):
        docs = docs.withColumn(name, F.lit(7))
    out = lc.dedup_line_chunks(docs, "doc_id", "text")
    assert out.columns == docs.columns
    found = out.collect()
    assert sorted([(r["doc_id"], r["text"]) for r in found], key=repr) == expected(rows)
    assert all(r["__gone"] == 7 and r["runs"] == 7 for r in found)
    assert lc.line_report(docs, "doc_id", "text").count() == len(rows)
    assert lc.line_report(docs.limit(0), "doc_id", "text").count() == 0


def test_texts_under_one_id_lose_only_their_own_repeats(spark):
    shared = "\n".join(f"shared line {i}" for i in range(30))
    texts = [shared + "\nfirst end", shared + "\nother end"]
    texts += ["\n".join(f"own {k} line {i}" for i in range(30)) for k in range(4)]
    for key in (None, 7):
        rows = [(key, t) for t in texts] + [(9, texts[0])]
        got = Counter(tuple(r) for r in lc.dedup_line_chunks(
            spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text").collect())
        # a text that occurs once stays whole, whatever other texts of its id lose
        assert all(got[(key, t)] == 1 for t in texts[2:])
        left = Counter(line for (_, t), n in got.items() for line in t.split("\n") * n)
        assert all(left[line] == 1 for line in shared.split("\n"))
