import re

import duckdb

from veritide.llm import quality, queries

SF = "/root/testdata/sf0.01"


def plain(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    rep = {i + k for i, t in enumerate(tri) if tri.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(rep)


def test_matches_sql(spark):
    got = sorted(tuple(r) for r in queries.op4_quality_lines(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    names = ", ".join(["doc_id", *quality.NAMES, "base_failed", "left_words", "kept"])
    assert got == sorted(con.execute(f"select {names} from ({quality.quality_sql()})").fetchall())


def test_measures():
    for t in [None, "", " \n", "a b c a b c", "a a a a a", "x\nx\n\n x\nx y # $|", "é\x85z\xa0k b", "a b c d\n" * 40, "q\x0bq\x0cq\rq"]:
        assert quality.measure(t)[:5] == plain(t)


def test_shared_lines_deplete(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    own = lambda k: " ".join(f"w{k}x{i}" for i in range(90)).translate(letters)
    line = " ".join(f"Common {i}" for i in range(90))
    rows = [(k, f"{line}\n{own(k)}", "h1", "a") for k in range(15)]  # 15 of 35 texts share the line
    rows += [(k, own(k), "h1", "a") for k in range(15, 35)]
    rows += [(k, f"{line}\nshort end", "h1", "b") for k in range(35, 37)]
    rows += [(99, line + "\n" + own(0), "h2", "c"), (98, line + " x", None, None), (None, None, None, None), (97, "", "h2", "")]
    rows += [(96, own(96), "h1", "z")] * 30  # copies count once
    rows += [(95, "\n".join(own(1000 + k) for k in range(400)) + "\n" + line, "h1", "very long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, HOST string")
    got = quality.quality(docs).collect()
    assert len(got) == len(rows)
    kept = {r.id: r.kept for r in got}
    assert all(kept[k] for k in [*range(35), 99, 98, 96, 95]) and not any(kept[k] for k in (35, 36, 97, None))
    assert {r.id: r.left_words for r in got}[3] == 90
    assert quality.quality(docs.limit(0)).count() == 0


def test_limit_does_not_rise_with_the_host(spark):
    own = lambda k: " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90))
    line = " ".join(f"Common {i}" for i in range(90))
    rows = [(k, f"{line}\n{own(k)}" if k < 11 else own(k), "h") for k in range(400)]  # with the last one, 12 of 401 texts share the line
    rows.append((400, line + "\nshort end", "h"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.id: (r.left_words, r.kept) for r in quality.quality(docs).collect()}
    assert got[400] == (2, False) and got[3] == (90, True)
