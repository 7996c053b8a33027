import random

from pyspark.sql import functions as F

from hushframe.llm import line_dedup


def brute(rows, min_words):
    """Lines deleted under the rule in dedup_lines, by comparing all runs of up to 40 lines (longer ones consist of such)."""
    docs = sorted({(2**63 - 1 if d is None else d, t) for d, t in rows if t is not None}, key=lambda x: x[0])
    lines = {x: x[1].split("\n") for x in docs}
    gone = {x: set() for x in docs}
    for k in range(1, min(40, max(map(len, lines.values()), default=0)) + 1):
        seen = set()
        for x in docs:
            for i in range(len(lines[x]) - k + 1):
                run = tuple(lines[x][i : i + k])
                if run in seen and len(" ".join(run).split()) >= min_words:
                    gone[x] |= set(range(i, i + k))
                seen.add(run)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0))
        else:
            x = (2**63 - 1 if d is None else d, t)
            out.append((d, "\n".join(s for i, s in enumerate(lines[x]) if i not in gone[x]), len(gone[x])))
    return sorted(out, key=str)


def run(spark, rows, min_words=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ln", F.lit(1)).withColumn("lines_deleted", F.lit("x")).repartition(3)
    got = line_dedup.dedup_lines(docs, min_words)
    assert got.columns == ["doc_id", "text", "ln", "lines_kept", "lines_deleted"]
    return sorted(((r.doc_id, r.text, r.lines_deleted) for r in got.collect()), key=str)


def test_equals_brute_force(spark):
    r = random.Random(4)
    vocab = [f"line {i} of" for i in range(25)] + [f"a longer line number {i} of five" for i in range(15)] + ["", "x"]
    rows = [(i, "\n".join(r.choices(vocab, k=r.choice([1, 3, 8, 20])))) for i in range(40)]
    passage = "\n".join(f"passage {i}" for i in range(11))
    rows += [(100 + i, f"own {i}\n{passage}\nend {i}") for i in range(6)]
    assert run(spark, rows) == brute(rows, 5)


def test_defined_cases(spark):
    long = "\n".join(f"very long text with line {i}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, ""), (4, long), (5, long), (None, long), (6, "one two three four five\none two three four five"), (7, "the.\nof."), (8, "the.\nof."), (9, "same same same same same"), (9, "same same same same same"), (10, "\n\n"), (11, "é ß x y z\r\nq"), (12, "é ß x y z\r\nw")]
    assert run(spark, rows) == brute(rows, 5)
    assert run(spark, []) == []


def every(rows, min_words):
    """Lines deleted by comparing runs of every length, for distinct ids and texts without null."""
    gone, seen = {}, set()
    for d, t in sorted(rows):
        x = t.split("\n")
        gone[d] = set()
        for i in range(len(x)):
            for k in range(1, len(x) - i + 1):
                run = tuple(x[i : i + k])
                if run in seen and len(" ".join(run).split()) >= min_words:
                    gone[d] |= set(range(i, i + k))
                seen.add(run)
    return sorted(((d, "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone[d]), len(gone[d])) for d, t in rows), key=str)


def test_equals_runs_of_every_length(spark):
    r = random.Random(8)
    menu = "home\nnews\nshop\nabout\nhelp\nlogin"
    rows = [(i, f"own {i}\n{menu}\nend {i}") for i in range(5)] + [(i, f"a {i}\nx y\nz w\nu v\nb {i}") for i in range(5, 8)]
    rows += [(i, f"c {i}\none two three four five six\nshort\nx\nd {i}") for i in range(8, 11)]
    rows += [(i, "\n".join(r.choices(["p", "q", "", "s t"], k=r.choice([3, 9, 25])))) for i in range(11, 40)]
    assert run(spark, rows) == every(rows, 5)
    assert run(spark, rows, 9) == every(rows, 9)


def test_long_texts_in_linear_time_and_clashing_names(spark):
    import time

    big = "\n".join(f"line {i} of a text with many lines" for i in range(100_000))
    rows = [(1, big), (2, "own first line of the second\n" + big + "\nown last line of the second"), (3, "line 7 of a text with many lines\nkept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'i' as _id", "'k' as _dk", "'g' as gone", "'r' as _row", "'h' as h", "'w' as w")
    began = time.time()
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 90
    assert got[1].text == big and got[2].text == "own first line of the second\nown last line of the second" and got[3].text == "kept"
    assert (got[2].lines_kept, got[2].lines_deleted) == (2, 100_000)
    assert all((r._id, r._dk, r.gone, r._row, r.h, r.w) == ("i", "k", "g", "r", "h", "w") for r in got.values())
