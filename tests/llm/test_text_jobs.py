"""Row-wise operators against plain Python."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, quality, secrets, token_files
from riskloom.llm import queries as Q

sha = lambda b: hashlib.sha256(b).hexdigest()


def got(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def clashing(docs):
    return docs.withColumns({"n_words": F.lit(-1), "ids": F.lit(b"x"), "spans": F.lit("y"), "fp": F.lit(1), "size": F.lit("z"), "range": F.lit(0)})


def plain_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 3000 else set(g for g in set(grams) if __import__("collections").Counter(grams)[g] > 1)
    hit = {j for i, g in enumerate(grams) if g in twice for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


def test_measures(spark, sf, sf_rows, odd_docs, odd_rows, no_docs):
    want = sorted(((i, *plain_quality(t)) for i, t in sf_rows), key=str)
    assert got(Q.op5_quality(spark, sf), "doc_id", *quality.MEASURES) == want
    small = [r for r in odd_rows if len(r[1] or "") < 50_000]
    want = sorted(((r[0], *plain_quality(r[1])) for r in small), key=str)
    few = odd_docs.where("coalesce(length(text), 0) < 50000")
    assert got(quality.measure(clashing(few), ["doc_id", "n_words"]), "doc_id", *quality.MEASURES) == want
    assert quality.judge(quality.measure(odd_docs, odd_docs.columns)).count() == len(odd_rows)
    assert quality.judge(quality.measure(no_docs, no_docs.columns)).collect() == []


def test_host_rules(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "too short"
    rows = [(i, good if i % 10 else bad, "clean") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "farm") for i in range(60)]
    rows += [(2000, bad, "new"), (2001, good, "new2"), (3000, good, None)]
    out = quality.judge(quality.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"])).collect()
    by = {r.doc_id: r for r in out}
    assert all(r.host_rejected == (r.source == "farm") for r in out if r.source in ("clean", "farm"))
    assert not by[2001].host_rejected and by[2001].kept and by[3000].kept
    assert all(r.kept == (not r.base_failed and not r.host_rejected) for r in out)
    hosts = spark.createDataFrame([("a", 100, 10), ("b", 100, 60), ("c", 2, 2)], "host string, host_docs long, host_failed long")
    alpha, beta = quality.beta_prior(hosts)
    n, kk, k = 202, 100 * .01 + 100 * .36 + 2, 72
    m = k / n
    s = m * (1 - m) / (kk / n - m * m - 3 * m * (1 - m) / n) - 1
    assert alpha == pytest.approx(m * s) and beta == pytest.approx((1 - m) * s)


def test_method_rules(spark):
    """Symbols, word lengths and duplicate lines reject documents and count for their hosts; the base verdict stays."""
    good = "one two three four five six seven eight nine ten eleven"
    bad = ["Ofthstrent### thoner$$$ to%%% one two three four five six seven eight", "a b c d e f g h i j k l m", " ".join(c * 12 for c in "abcdefghijk"),
           "alpha\nbeta one two\nalpha\ngamma three four\nalpha\ndelta five six\nalpha"]
    rows = [(i, good, "clean") for i in range(100)] + [(100 + i, b, "clean") for i, b in enumerate(bad)]
    rows += [(200 + i, bad[0] if i % 10 else good, "farm") for i in range(60)]
    out = {r.doc_id: r for r in quality.judge(quality.measure(spark.createDataFrame(rows, "doc_id long, text string, source string"), ["doc_id", "source"])).collect()}
    assert not any(r.base_failed for r in out.values())
    assert all(out[i].kept for i in range(100)) and not any(out[100 + i].kept for i in range(len(bad)))
    assert all(r.host_rejected == (r.source == "farm") and not (r.source == "farm" and r.kept) for r in out.values())


def test_secret_forms(spark, sf, sf_rows):
    def plain(t):
        found = [(m.start(), m.end(), 0, "assign") for m in re.finditer(
            r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t)
            if len(m[2]) >= 6]
        found += [(m.start(), m.end(), 1, "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), m.end(), 2, "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        found.sort(key=lambda x: (x[0], x[2]))
        return (*(sum(x[2] == k for x in found) for k in range(3)), sha(",".join(f"{k}:{a}:{b}" for a, b, _, k in found).encode()))

    assert got(Q.op10_secrets(spark, sf), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(((i, *plain(t)) for i, t in sf_rows), key=str)


def test_secret_windows(spark, odd_docs, odd_rows, no_docs):
    for s in ("abcabcabcabcabcabcabcabcabc", "Zq8vLw3nTy6RkP1sXd9BfHgJ", "aaaaaaaaaaaaaaaaaaaaab"):
        for i, e in enumerate(secrets.window_entropy(s, 20)):
            w = s[i : i + 20]
            assert e == pytest.approx(-sum(w.count(c) / 20 * __import__("math").log2(w.count(c) / 20) for c in set(w)))
    assert secrets.joined(secrets.all_spans("see Zq8vLw3nTy6RkP1sXd9BfHgJ now")[1]) == "entropy_mixed:4:28"
    assert secrets.all_spans("id 123e4567-e89b-42d3-a456-426614174000 and internationalization-of-everything 12345678901-234567890-12345")[1] == []
    assert secrets.all_spans("token: token: abcdefgh")[0] == [] and secrets.all_spans("ſecret: abcdefgh")[0] == []
    assert secrets.redact_text("a token = abcdef123 b") == "a [SECRET] b"
    out = secrets.redact(odd_docs)
    assert out.columns == odd_docs.columns and got(out, *out.columns) == got(odd_docs, *out.columns)
    assert got(secrets.scan(clashing(odd_docs), ["doc_id", "spans"]), "doc_id", "spans") == sorted(((r[0], "") for r in odd_rows), key=str)
    assert secrets.scan(no_docs, ["doc_id"]).collect() == []


def test_random_keys_are_found():
    import random
    import string

    rng = random.Random(5)
    for n, most in ((20, .08), (24, .05), (32, .02)):
        keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for _ in range(1000)]
        assert sum(not secrets.all_spans(f"see {k} now")[1] for k in keys) <= most * len(keys), n
    key = "Zq8vLw3nTy6RkP1sXd9BfHgJ"
    for before in ("sample_client_id=", "example/", "a-dummy_", "id-123e4567-e89b-42d3-a456-426614174000/", "xxxx-"):
        assert any(a <= len(before) and b == len(before) + len(key) for a, b, _ in secrets.all_spans(before + key)[1]), before
        assert key[:20] not in secrets.redact_text(before + key)
    for s in ("see id=123e4567-e89b-42d3-a456-426614174000", "key-example1q8vLw3nTy6RkP1sXd9BfHgJ", "blog/2024/05/12/some_long_title-of-version2_page"):
        assert secrets.all_spans(s)[1] == [], s


def plain_hits(text, items, width=10):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    words, hit, met = cut(text), set(), set()
    at = {}
    for n, (i, t) in enumerate(items):
        w = cut(t)
        for g in ({tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))} if w else ()):
            at.setdefault(g, set()).add(i)
    for k in {len(g) for g in at}:
        for j in range(len(words) - k + 1):
            if (g := tuple(words[j : j + k])) in at:
                hit |= set(range(j, j + k))
                met |= at[g] - {None}
    return len(words), len(hit), len(met), sha(",".join(sorted(map(str, met))).encode()), bool(hit)


def test_decontaminate(spark, sf, sf_rows, odd_docs, odd_rows, no_docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = sorted(((i, *plain_hits(t, items)) for i, t in sf_rows), key=str)
    assert got(Q.op3_decontaminate(spark, sf), "doc_id", *decontaminate.FOUND) == want and any(w[-1] for w in want)
    items = [(1, "Alpha, the"), (2, "alpha the"), (3, odd_rows[3][1][40:160]), (4, None), (5, ""), (None, odd_rows[2][1][:80]), (6, "!!"), (6, "one TWO"), (9, "zzz yyy")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    few = odd_docs.where("coalesce(length(text), 0) < 50000")
    want = sorted(((r[0], *plain_hits(r[1], items)) for r in odd_rows if len(r[1] or "") < 50_000), key=str)
    assert got(decontaminate.scan(clashing(few), bench, ["doc_id", "n_words"]), "doc_id", *decontaminate.FOUND) == want
    clean = decontaminate.drop_documents(odd_docs, bench)
    assert clean.columns == odd_docs.columns and all(not plain_hits(r.text, items)[-1] for r in clean.collect())
    cut = decontaminate.drop_spans(spark.createDataFrame([(1, "Keep this. One, TWO! and this"), (2, None)], "doc_id long, text string"), bench)
    assert got(cut, "text") == [("Keep this. ! and this",), (None,)]
    assert decontaminate.scan(odd_docs, bench.limit(0), ["doc_id"]).where("contaminated").count() == 0
    assert decontaminate.drop_documents(no_docs, bench).collect() == []
    with pytest.raises(ValueError):
        decontaminate.scan(odd_docs, bench, ["doc_id"], most_windows=1)


def test_bpe(spark, sf, sf_rows, odd_docs, odd_rows, no_docs):
    tiktoken, p = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = p.path(Q.BPE_FILE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(t):
        ids = e.encode_ordinary(t or "")
        return len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha((t or "").encode())

    assert got(Q.op6_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(((i, *want(t)) for i, t in sf_rows), key=str)
    coded = bpe.encode(clashing(odd_docs), ["doc_id", "text", "ids"], path, p.PATTERN)
    for r in bpe.decoded(coded, ["text", "ids"], path).collect():
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in e.encode_ordinary(r.text or "")) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(no_docs, ["doc_id"], path, p.PATTERN).collect() == []


def test_merge_replay_is_greedy():
    """Random vocabularies, also such where a merge brings up a pair of less rank."""
    import random

    rng = random.Random(3)
    for _ in range(200):
        parts = {bytes([b]) for b in b"abc"}
        while len(parts) < 25:
            parts.add(rng.choice(sorted(parts)) + rng.choice(sorted(parts)))
        rest = [x for x in sorted(parts) if len(x) > 1]
        rng.shuffle(rest)
        ranks = {bytes([b]): b for b in range(256)} | {x: 256 + i for i, x in enumerate(rest)}

        def plain(w):
            if w in ranks:
                return [ranks[w]]
            s = [bytes([b]) for b in w]
            while pairs := [(ranks[s[i] + s[i + 1]], i) for i in range(len(s) - 1) if s[i] + s[i + 1] in ranks]:
                i = min(pairs)[1]
                s[i : i + 2] = [s[i] + s[i + 1]]
            return [ranks[x] for x in s]

        words = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) for _ in range(30)]
        assert bpe.MergeReplay(ranks).encode(words) == [plain(w) if w else [] for w in words]


def test_token_files(spark, sf, sf_rows, odd_docs, odd_rows, no_docs, tmp_path):
    Tokenizer, p = pytest.importorskip("tokenizers").Tokenizer, pytest.importorskip("public_tokenizers")
    t = Tokenizer.from_file(p.path(Q.LIBRARY_FILE))

    def want(rows):
        out, start = [], 0
        for i, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
            ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
            out.append((i, start, len(ids), zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids))))
            start += len(ids)
        return sorted(out, key=str)

    columns = ("doc_id", "start", "n_tokens", "ids_crc32")
    assert got(Q.op9_token_files(spark, sf), *columns) == want(sf_rows)
    files = token_files.write(clashing(odd_docs), str(tmp_path / "odd"), p.path(Q.LIBRARY_FILE), p.PATTERN, 2)
    assert got(token_files.read(spark, files), *columns) == want([r[:2] for r in odd_rows])
    marked = [(0, "a <|endoftext|> b"), (1, "<|endoftext|>"), (2, "<|endoftext|> start"), (3, "end<|endoftext|>"), (4, "twice <|endoftext|><|endoftext|>\n x"),
              (5, "<|endoftext| > not"), (6, "plain text after"), (7, None)]
    files = token_files.write(spark.createDataFrame(marked, "doc_id long, text string"), str(tmp_path / "marked"), p.path(Q.LIBRARY_FILE), p.PATTERN, 2)
    assert got(token_files.read(spark, files), *columns) == want(marked)
    assert 50256 in t.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert token_files.read(spark, token_files.write(no_docs, str(tmp_path / "none"), p.path(Q.LIBRARY_FILE), p.PATTERN, 2)).collect() == []


@pytest.mark.parametrize("pattern", [None, r"\S+|\s+", r"(?s: ?\w|.)"])
def test_new_chunks_are_cut_at_once(pattern):
    import public_tokenizers

    from riskloom.llm.pieces import ChunkCoder

    code = ChunkCoder(pattern or public_tokenizers.PATTERN, lambda words: [list(w.encode()) for w in words], "<u2")
    data = [f"Word{i} it's{i}, a\n{i}b \u00fcber{i}... ({i}) {i}%" for i in range(40)] + ["", " x  y ", "a"]
    cut, calls = code.cut, []
    code.cut = lambda x: (calls.append(x), cut(x))[1]
    assert [np.frombuffer(x, "<u2").astype(np.uint8).tobytes().decode() for x in code.ids(data)] == data
    if pattern is None:
        assert len(calls) <= 2 * len(data) + 10


def test_a_chunk_is_looked_up_once_a_batch():
    import public_tokenizers
    from riskloom.llm.pieces import ChunkCoder

    class Counted(dict):
        n = 0

        def __getitem__(self, key):
            self.n += 1
            return super().__getitem__(key)

    code = ChunkCoder(public_tokenizers.PATTERN, lambda words: [list(w.encode()) for w in words], "<u2")
    code.chunks = Counted()
    data = ["of the of " * 500 + "end", "", "the  odd of", "of", " of the", "a \n"]
    assert [bytes(x[::2]).decode() for x in code.ids(data)] == data
    assert code.chunks.n <= 10


def test_pieces_are_lettered_together():
    letters = token_files.byte_letters()
    pieces = [" the", "ÿ", "\x00\xad\n", " Ġé日\U0001f600", "", "\x7f\x85\xa0"]
    assert token_files.lettered(pieces) == [p.encode().decode("latin-1").translate(letters) for p in pieces]
    assert token_files.lettered([]) == []
