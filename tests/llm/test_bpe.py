import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from veritide.llm import bpe, queries

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    tok = Tokenizer.from_file(PATH)
    out = []
    for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False):
        ids = ",".join(map(str, e.ids))
        text = tok.decode(e.ids, skip_special_tokens=False)
        out.append((len(e.ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    return out


def test_matches_library(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_bpe_chunks(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in docs], plain([r.text for r in docs]), strict=True))


def test_edge_rows(spark):
    rng = random.Random(3)
    odd = ["", None, " ", "\n\n \t x  ", "a" * 30_000, "é" * 9_000, "<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "日本語 " * 3000, "  lead", "trail   ", "it's we'LL 12 345  !!\n"]
    base = "".join(rng.choice(["ab", " ", "  ", "\n", "é", "<|endoftext|>", "x1", " the", "　", "\xa0", "'s", "!"]) for _ in range(20_000))
    odd += [base, base, base[:9000] + "Q" + base[9000:], base[500:], "head " + base]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(odd)] + [(None, "x", 2), (0, "", 3)], "doc_id long, text string, uid int")
    got = sorted([tuple(r) for r in bpe.bpe_encode(docs, PATH, keep_ids=False).collect()], key=lambda r: (r[0] is None, r[0] or 0))
    want = [(0, *plain([""])[0]), *[(k, *w) for k, w in enumerate(plain(odd))], (None, *plain(["x"])[0])]
    assert got == want
    back = bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()
    assert sorted((r.id is None, r.id or 0, r.text) for r in back) == sorted([*((False, k, t or "") for k, t in enumerate(odd)), (True, 0, "x"), (False, 0, "")])
    assert all(len(r.ids) == r.n_tokens for r in back)
    assert bpe.bpe_encode(docs.limit(0), PATH).count() == 0


def test_join_of_any_chunks():
    rng = random.Random(11)
    c = bpe.codec(PATH)
    for _ in range(300):
        text = "".join(rng.choice(["a", " ", "  ", "\n", "é", "<|endoftext|>", "12", " the", " ", "'s", "."]) for _ in range(rng.randrange(60)))
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, rng.randrange(6))))
        j = bpe.Joiner(c)
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            j.add(*bpe.encode_part(c, text[a:b]))
        assert j.finish() == c.encode(text)


def test_seams_of_texts_without_spaces_take_linear_time():
    c = bpe.codec(PATH)
    text = "".join(random.Random(5).choice("日本語文字列の例です") for _ in range(60_000))
    parts = [text[k : k + 300] for k in range(0, len(text), 300)]
    j = bpe.Joiner(c)
    for p in parts:
        j.add(*bpe.encode_part(c, p))
    assert len(j.open) == len(parts) and j.finish() == c.encode(text)
