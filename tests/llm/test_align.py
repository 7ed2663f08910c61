import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import align
from riskloom.llm.token_files import byte_letters

A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_FILE), SentencePieceProcessor(model_file=B_FILE)
    a.encode_special_tokens = True
    back = {v: k for k, v in byte_letters().items()}
    a_bytes = {i: bytes(back[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in back for c in t)}
    b_bytes = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
               for i in range(b.get_piece_size())}
    return lambda x: a.encode(" " + x, add_special_tokens=False).ids, b.encode, a_bytes, b_bytes


def spans(sizes):
    ends = np.cumsum(sizes).tolist()
    return list(zip([0, *ends], ends))


def plain(libraries, text):
    """Ids, groups and links by byte ranges; None where a text has no tokens."""
    encode_a, encode_b, a_bytes, b_bytes = libraries
    if not text:
        return None
    a, b = encode_a(text), encode_b(text)
    if any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in ((a_bytes, a), (b_bytes, b))):
        return None
    left, right = spans([len(a_bytes[i]) for i in a]), spans([len(b_bytes[i]) for i in b])
    cuts = sorted({e for _, e in left} & {e for _, e in right})
    groups, links, first = [], [], 0
    place = {e: k for k, e in enumerate(cuts)}
    members: list = [([], []) for _ in cuts]
    for side, (ids, where) in enumerate(((a, left), (b, right))):
        k = 0
        for i, (_, e) in zip(ids, where):
            members[k][side].append(i)
            k += e in place
    groups = ["|".join(",".join(map(str, s)) for s in m) for m in members]
    for i, (x, y) in zip(a, left):
        while right[first][1] <= x:
            first += 1
        j = first
        while j < len(b) and right[j][0] < y:
            links.append((i, b[j]))
            j += 1
    return a, b, groups, links


def brute(libraries, rows):
    found = [plain(libraries, x) for _, x in rows]
    counts = Counter(p for f in found if f for p in f[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc, _), f in zip(rows, found):
        if f is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            out.append((doc, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                        hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return Counter(out)


def aligned(docs, keep=("doc_id",), **more):
    return align.align(docs, list(keep), A_FILE, P.PATTERN, B_FILE, **more)


ODD = ["<|endoftext|> and <s> </s> <0x41> <unk>", "a▁b", "▁", " ", "   ", "  two  spaces ", "tab\there\n\nlines \r\n x", "x", " no-break  wide ", "é é ﬁ Ａ\U0001f600",
       "a\x00b\x1c c", "ab" * 3000, "word " * 2500, "e​ ​f", "\n", "日本語のテキスト です", "it's don't WE'LL 1234567890 --==--"]


@pytest.mark.parametrize("most_pairs", [align.MOST_PAIRS, 40, 0])
def test_odd_rows(spark, odd_docs, odd_rows, libraries, most_pairs):
    more = [(100 + i, x) for i, x in enumerate(ODD)]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(extra).withColumn("codes", F.lit(1)).withColumn("n_a", F.lit("x"))
    out = aligned(docs, ["doc_id", "n_a"], most_pairs=most_pairs)
    assert out.columns == ["doc_id", *NAMES]
    assert Counter(map(tuple, out.collect())) == brute(libraries, [r[:2] for r in odd_rows] + more)


def test_sf_rows(spark, sf, sf_rows, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert Counter(map(tuple, aligned(docs).collect())) == brute(libraries, sf_rows)


def test_empty_table(no_docs):
    assert not aligned(no_docs).count()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab  \n'é▁日1 \x1c.", max_size=60), max_size=6), st.integers(1, 12))
def test_whole_texts_by_lanes(libraries, texts, lane):
    """Short lanes and a shared cache give what the libraries give for whole texts."""
    before, align.LANE = align.LANE, lane
    try:
        sides = _sides()
        data = [x.encode() for x in texts]
        columns = align.align_texts(data, sides, align.Speller(50_257))
    finally:
        align.LANE = before
    for x, row in zip(texts, zip(*columns[:5])):
        f = plain(libraries, x)
        want = (0, 0, 0, 0, "") if f is None else (len(f[0]), len(f[1]), len(f[2]), len(f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        assert row == want, x


_held: list = []


def _sides():
    if not _held:
        _held.append(align.Sides(align._read(A_FILE).decode(), P.PATTERN, align._read(B_FILE)))
    return _held[0]


def test_counts_over_a_byte_are_split():
    codes, times = align._packed(np.array([5, 9], "<u4"), np.array([700, 3]), np.array([0, 1]), 3)
    assert [np.frombuffer(x, "<u4").tolist() for x in codes] == [[5, 5, 5], [9], []]
    assert [list(x) for x in times] == [[255, 255, 190], [3], []]
