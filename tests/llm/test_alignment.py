import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waymark.llm import alignment
from waymark.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_groups(text, a, b):
    """Groups of a whole text as (A ids, B ids), by the sets of byte ends; None where tokens are not its bytes."""
    letters = {v: k for k, v in alignment.byte_letters().items()}
    back = {letter: byte for byte, letter in letters.items()}
    whole = (" " + text).encode()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(back[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    if b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
        return None
    a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
    found, p, q = [], 0, 0
    for end in sorted(set(a_ends.tolist()) & set(b_ends.tolist())):
        r, s = int(np.searchsorted(a_ends, end)) + 1, int(np.searchsorted(b_ends, end)) + 1
        found.append((a_ids[p:r], b_ids[q:s]))
        p, q = r, s
    return found


def plain(texts):
    a, b = libraries()
    groups = [plain_groups(t, a, b) if t else None for t in texts]
    counts = Counter(pair for g in groups if g for pair in {(x, y) for xs, ys in g for x in xs for y in ys})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for g in groups:
        if g is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        digest = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((
            sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == most[p[0]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(digest.encode()).hexdigest(),
        ))
    return out


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r["doc_id"] for r in rows], plain([r["text"] for r in rows])))
    got = QUERIES["op13_alignment"](spark, sf).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want and len(got) == len(rows)


ODD = [
    None, "", " ", "x", " lead", "trail ", "two  spaces   three", "tabs\tand\nlines \n next", "a▁b stays out", "<|endoftext|> <s> </s> <unk> <0x41>",
    "नमस्ते दुनिया", "日本語 テキスト ①②", "é é ﬁ ½", "　wide no-break​zero", "\x00 null \x1c sep", "🙂🙂 🙂", "don't we'll I'm", "a▁b again, longer   text▁",
    "1234567890 12,345.67", "ab" * 3000, "नी" * 400, " " * 50, "▁",
]


def test_odd_texts_small_chunks_and_blocks(spark, monkeypatch):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice(["a", "the", " ", "  ", "é", "\n", "日", "ing", "X", ".", "q7"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    want = plain(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "x"), (None, None)]
    extra = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as id", "2 as chunk", "3 as place", "4 as n_a")
    want_rows = Counter((i, *w) for (i, t), w in zip(rows, plain([t for _, t in rows])))
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in alignment.aligned(extra, A, B).collect()) == want_rows
    assert alignment.aligned(extra.where("doc_id > 9000"), A, B).collect() == []
    both = alignment.Aligned(alignment.Vocabularies(A, B))
    monkeypatch.setattr(alignment, "KNOWN_PIECES", 40)
    monkeypatch.setattr(alignment, "GROUP_CHARS", 100)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 3)
    monkeypatch.setattr(alignment, "blocks_of", lambda text, f=alignment.blocks_of: f(text, 20))
    for links, w in zip(both.documents(texts), want, strict=True):
        assert links.row == (*w[:4], w[6])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=60), st.lists(st.integers(1, 4), min_size=1, max_size=60))
def test_groups_from_any_ends(a, b):
    a, b = np.cumsum(a), np.cumsum(b)
    end = max(a[-1], b[-1])
    a, b = (np.append(x, end) if x[-1] < end else x for x in (a, b))
    shared = sorted(set(a.tolist()) & set(b.tolist()))
    starts = alignment.groups(a, b)
    for x, found in ((a, starts[0]), (b, starts[1])):
        assert found.tolist() == [0, *(int(np.searchsorted(x, e)) + 1 for e in shared[:-1])]


def test_a_long_word_and_a_long_text():
    both = alignment.Aligned(alignment.Vocabularies(A, B))
    rng = random.Random(4)
    word = "".join(rng.choices("abcdefghij", k=60_000))
    text = " ".join("".join(rng.choices("aeioutnsr", k=rng.randrange(1, 9))) for _ in range(150_000))
    for t, links in zip((word, text), both.documents([word, text])):
        g = plain_groups(t, *libraries())
        digest = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        assert links.row[2:] == (len(g), sum(len(x) * len(y) for x, y in g), hashlib.sha256(digest.encode()).hexdigest())
