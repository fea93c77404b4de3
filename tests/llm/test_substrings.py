import random

import numpy as np

from veritide.llm import chunks, queries, substrings

SF = "/root/testdata/sf0.01"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_gear_hash_sees_its_window_only():
    data = np.random.default_rng(0).integers(0, 256, 400).astype(np.uint8)
    want = [sum(int(chunks.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % 2**32 for i in range(len(data))]
    assert chunks.gear_hash(data).tolist() == want


def test_chunks_resist_insertions():
    rng = random.Random(4)
    text = words(rng, 3000)
    a = set(substrings.chunk_digests(text)[1].tolist())
    b = substrings.chunk_digests(text[:7000] + "INSERTED" + text[7000:])[1].tolist()
    assert sum(x not in a for x in b) <= 8
    for t in ["é" * 500, "", "日本 " * 300, "x" * 5000]:
        ends, got = substrings.chunk_digests(t)
        data = t.encode()
        assert len(ends) == len(got) and (not data or ends[-1] == len(data))
        assert all(data[a:b].decode() is not None for a, b in zip([0, *ends], ends, strict=False))


def brute(rows, least):
    """The same rule with plain dictionaries of chunk texts."""
    place, cut = {}, []
    for k, (_, text) in enumerate(rows):
        data = (text or "").encode()
        ends = chunks.cut_points(data, substrings.BITS, substrings.MOST, substrings.LEAST).tolist()
        cut.append([(s, a, b, data[a:b]) for s, (a, b) in enumerate(zip([0, *ends], ends, strict=False))])
        for s, _, _, c in cut[-1]:
            place.setdefault(c, []).append((k, s))
    out = []
    for k, parts in enumerate(cut):
        hit = [(s, a, b, place[c][0] == (k, s)) for s, a, b, c in parts if len({at for at, _ in place[c]}) > 1]
        gone = set()
        for i, h in enumerate(hit):
            lo = hi = i
            while lo and hit[lo - 1][0] == hit[lo][0] - 1:
                lo -= 1
            while hi + 1 < len(hit) and hit[hi + 1][0] == hit[hi][0] + 1:
                hi += 1
            if not h[3] and hit[hi][2] - hit[lo][1] >= least:
                gone |= set(range(h[1], h[2]))
        out.append(bytes(x for i, x in enumerate((rows[k][1] or "").encode()) if i not in gone).decode())
    return out


def test_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(tuple(r) for r in docs.collect())
    got = {r.doc_id: r.text for r in queries.op6_substring_chunks(spark, SF).collect()}
    assert [got[d] for d, _ in rows] == brute(rows, substrings.LEAST_RUN)


def test_passages_and_edge_rows(spark):
    rng = random.Random(8)
    passage = words(rng, 55)
    rows = [(k, f"{words(rng, 80)} {passage} {words(rng, 80)}", "x") for k in range(12)]
    rows += [(20 + k, words(rng, 200), "x") for k in range(10)]
    rows += [(30, f"{words(rng, 60)} " * 4, "x")]  # repeats itself, but no other text
    rows += [(40, None, "x"), (41, "", "x"), (None, words(rng, 30), None), (42, "é" * 300, "y"), (42, "é" * 300, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, UID string").coalesce(1)
    got = substrings.repeated_passages(docs).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    assert all(by[k].repeated_bytes > 100 for k in range(12)) and sum(by[k].removed_bytes > 100 for k in range(12)) == 11
    assert all(by[20 + k].repeated_bytes == 0 and by[20 + k].text == rows[12 + k][1] for k in range(10))
    assert by[30].repeated_bytes == 0
    assert by[40].text is None and by[41].text == "" and sorted(r.removed_bytes for r in got if r.id == 42)[1] > 500
    assert substrings.repeated_passages(docs.limit(0)).count() == 0
