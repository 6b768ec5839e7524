"""Secrets, token files, urls, byte-pair encoding, media and languages against brute force or round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewright.llm import bpe, hosts, langid, queries, secrets, tokenfiles, transport

SF = "/root/testdata/sf0.001"
ODD = [(0, None), (1, ""), (2, " "), (3, "\x00\u2028é日本🙂"), (4, "a" * 5000), (5, "x y\r\n\t z"), (6, "same"), (7, "same"), (7, "same"), (None, "no id")]


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def test_secrets(table, clash, documents):
    tail = [(10**6 + i, t) for i, t in ODD if i is not None]
    tail += [(2 * 10**6, 'é API_KEY = "abcdef12" token:short, Password:"xY9+/_.=-" AKIA' + "Z" * 16 + " " + "0a" * 12 + " token=a"), (2 * 10**6 + 1, "secret=secret=abcdef " * 700)]
    rows = [(d["doc_id"], d["text"]) for d in documents] + tail
    docs = clash(table(rows))
    model = secrets.fit(secrets.default_samples(docs))
    got = sorted((r["doc_id"], [tuple(s) for s in r["base"]], [tuple(s) for s in r["spans"]]) for r in secrets.find_secrets(docs, model).collect())
    assert [g[0] for g in got] == sorted(r[0] for r in rows)
    texts = dict(rows)
    for doc, base, spans in got:
        text = texts[doc] or ""
        want = []
        pattern = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
        want += [(m.start(), 0, m.end()) for m in pattern.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        assert base == sorted(want), doc
        assert [s for s in spans if s[1] < 3] == base
        assert all(s[2] <= b[0] or b[2] <= s[0] for s in spans if s[1] == 3 for b in base)


def test_secret_models(table):
    docs = table([(i, " ".join(f"some ordinary words for user account number {j}" for j in range(5))) for i in range(50)])
    model = secrets.fit(secrets.default_samples(docs))
    rng = random.Random(3)
    random_ones = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40)) for _ in range(40)]
    plain = [f"ordinary_account_number_{i}_for_some_user" for i in range(40)]
    got = secrets.find_secrets(table(list(enumerate(random_ones + plain))), model)
    found = {r["doc_id"] for r in got.collect() if r["spans"]}
    assert len([i for i in found if i < 40]) >= 36 and len([i for i in found if i >= 40]) <= 2


def test_token_files(spark, table, clash, documents, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(d["doc_id"], d["text"]) for d in documents] + [(10**6 + k, t) for k, (_, t) in enumerate(ODD)] + [(2 * 10**6, "<|endoftext|> don't, U.S.A. x<|pad|>y")]
    tokenfiles.write_token_files(clash(table(rows)), str(tmp_path / "files"), path, 1, block_ids=5000)
    got = [tuple(r) for r in tokenfiles.read_token_files(spark, str(tmp_path / "files")).orderBy("start").select("doc_id", "start", "ids").collect()]
    at = 0
    assert len(got) == len(rows)
    for (doc, text), (found, start, ids) in zip(sorted(rows), got):
        want = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (found, start, bytes(ids)) == (doc, at, want.tobytes()), doc
        at += len(want)


def test_token_files_of_any_tokenizer_and_ids(spark, table, tmp_path):
    """A tokenizer that minds case gets whole texts; ids are text, null and repeated."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [("b", "The Cat, THE cat"), (None, "no id"), ("a", "Don't  stop\n"), ("b", "again"), (None, None), ("b", "The Cat, THE cat")]
    tokenfiles.write_token_files(table(rows, "doc_id string, text string"), str(tmp_path / "files"), path, 7)
    got = tokenfiles.read_token_files(spark, str(tmp_path / "files")).orderBy("start").collect()
    want = [(i, np.array([*plain.encode(t or "", add_special_tokens=False).ids, 7], "<u4").tobytes()) for i, t in rows]
    assert [r["doc_id"] for r in got] == [None, None, "a", "b", "b", "b"]
    assert sorted(((r["doc_id"] or "", bytes(r["ids"])) for r in got)) == sorted((i or "", w) for i, w in want)
    assert [r["start"] for r in got] == list(np.cumsum([0, *(len(r["ids"]) // 4 for r in got[:-1])]))


def test_packed_blocks():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        counts = np.array([n // 2, n - n // 2])
        back, sizes = tokenfiles.unpack(tokenfiles.pack(ranks, counts))
        assert (back == ranks).all() and (sizes == counts).all()


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=(None, None, None))
    return host, path, best[0] and best[0] + best[1], best[2]


def test_urls(table, clash):
    urls = [None, "", "no scheme", "http://", "HTTP://Www.Example.NET/en/x?q#f", "http://example.net/de/", "http://notexample.net", "https://a.example.com/de/", "http://x.org/fr/a?b", "http://x.org?fr/", "a://b://c/d", "http://bad.example.xyz/1", "http://good.example.xyz/1", "http://new.example.xyz/", "http://É.com/ä"]
    outcomes = [("http://bad.example.xyz/x", 0)] * 60 + [("http://good.example.xyz/x", 1)] * 60 + [(None, 1), ("http://bad.example.xyz/x", None)]
    pages = clash(table(list(enumerate(urls)), "page_id long, url string"))
    found = {r["page_id"]: r for r in hosts.filter_urls(pages, table(outcomes, "url string, good int")).collect()}
    assert len(found) == len(urls)
    for i, url in enumerate(urls):
        host, path, rule, verdict = judged(url)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule), url
        assert found[i]["verdict"] == (verdict or ("block" if "bad." in (url or "") else "allow")), url
    without = hosts.filter_urls(pages, table([], "url string, good int")).collect()
    assert all(r["verdict"] == "allow" for r in without if r["rule"] is None)


def test_byte_bpe(table, clash, documents):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    plain = bpe.encoding(path, pattern)[0]
    rng = random.Random(9)
    odd = ["".join(rng.choice(["a", "B", " ", "  ", "\n", "\t", "'s", "1", "é", "日本", "-", "🙂", "<|endoftext|>"]) for _ in range(2000)) for _ in range(6)] + [" " * 3000, "a" * 3000, "x" + "\n" * 900 + "1" * 900, "=" * 1500]
    rows = [(d["doc_id"], d["text"]) for d in documents[:200]] + [(10**6 + k, t) for k, (_, t) in enumerate(ODD)] + [(2 * 10**6 + k, t) for k, t in enumerate(odd)]
    got = {r["doc_id"]: r for r in bpe.encode_texts(clash(table(rows)), path, pattern, chunk=300, overlap=40).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        want = np.array(plain.encode_ordinary(text or ""), "<u4")
        assert bytes(got[doc]["ids"]) == want.tobytes(), doc
        assert got[doc]["n_tokens"] == len(want) and bytes(got[doc]["raw"]).decode() == (text or "")


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 163, 175, 176, 183, 184, 190, 16384, 16385, 50000])
@pytest.mark.parametrize("unit", [1, 170, 16384])
def test_transport_round_trip(size, unit):
    if size > 1000 and unit == 1:
        size = 500
    payload = random.Random(size).randbytes(size)
    stream = transport.mux(payload, unit)
    read = transport.demux(stream)
    assert len(stream) % 188 == 0 and set(stream[::188]) <= {0x47}
    assert read["payload"] == payload and read["errors"] == 0
    assert [u[2:] for u in read["units"]] == [(i, min(size, i + unit)) for i in range(0, size, unit)]
    assert [u[0] for u in read["units"]] == [k * 3600 for k in range(len(read["units"]))] and all(u[1] for u in read["units"])


def test_transport_damage():
    stream = transport.mux(bytes(range(256)) * 40, 3000)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert transport.demux(b"".join(packets[:6] + packets[7:]))["errors"] > 0
    assert transport.demux(b"".join(packets[:6] + [packets[5]] + packets[6:]))["errors"] == 0
    assert transport.demux(stream[:-1])["errors"] > 0
    assert transport.demux(b"")["payload"] == b""


def test_damaged_streams_are_read_as_far_as_they_go():
    rng = np.random.default_rng(11)
    whole = np.frombuffer(transport.mux(bytes(range(256)) * 9, unit=700), np.uint8)
    for _ in range(3000):
        own = whole.copy()
        at = rng.integers(0, len(own), rng.integers(1, 6))
        own[at] = rng.integers(0, 256, len(at))
        if rng.random() < 0.5:  # fields that fill their packets
            p = 188 * int(rng.integers(0, len(own) // 188))
            own[p + 3] |= 0x20
            own[p + 4] = rng.integers(170, 256)
        read = transport.demux(own[: rng.integers(1, len(own) + 1)].tobytes())
        assert isinstance(read["errors"], int) and read["payload"] is not None


def test_domains_and_suffixes(table):
    rows = [("http://bad.co.uk/", "bad.co.uk", "co.uk"), ("http://u:p@x.Good.org:8080/", "good.org", "org"), ("http://10.0.0.1:80/", "10.0.0.1", "10.0.0.1"), ("http://a.b.example.com", "example.com", "com")]
    df = table([(i, u) for i, (u, _, _) in enumerate(rows)], "i int, url string").select("i", hosts.host_of(F.col("url")).alias("h"))
    got = {r["i"]: (r["d"], r["s"]) for r in df.select("i", hosts.domain_of(F.col("h")).alias("d"), hosts.suffix_of(F.col("h")).alias("s")).collect()}
    assert got == {i: (d, s) for i, (_, d, s) in enumerate(rows)}


def test_media(table, clash, spark):
    docs = clash(table(ODD))
    got = transport.demux_column(transport.mux_texts(docs), ["doc_id", "n_bytes"]).collect()
    want = sorted((str(i), len((t or "").encode()), transport.padded(t)[1]) for i, t in ODD)
    assert sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["payload"])) for r in got) == want
    row = queries.QUERIES["op9_media"](spark, SF).first()
    assert row["payload_bytes"] % 64 == 0 and re.fullmatch("[0-9a-f]{64}", row["media_sha256"])
    text = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}[row["doc_id"]]
    assert row["payload_sha256"] == hashlib.sha256(transport.padded(text)[1]).hexdigest()
    assert row["tail_crc32"] == zlib.crc32(transport.padded(text)[1][-64:])


def test_language_held_out(spark):
    rows = queries.QUERIES["op10_language"](spark, "/root/testdata/sf0.01").collect()
    true = {d["doc_id"]: d["lang"] for d in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    assert len(rows) == len(true)
    held = [r for r in rows if r["held_out"] and true[r["doc_id"]]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(table, clash):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34!", "de"), (103, "the dog", None), (None, "und der Hund", None), (104, "THE CAT", "en")]
    docs = clash(table(rows, "doc_id long, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, langid.train(docs)).collect()}
    assert [got[i] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert (got[103][0], got[None][0], got[104][0]) == ("en", "de", "en")
    blank = langid.train(table([(1, "text", None)], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in langid.identify(docs, blank).collect()} == {"und"}


def test_kernel_is_the_stated_one():
    """Scores of the folded table equal those of landmark kernels, computed pair by pair."""
    texts, langs = ["abc abd", "xyz xyw", "abd abc", "xyw zzz"], ["a", "b", "a", "b"]
    model = langid.fit(texts, langs, landmarks=4)

    def grams(t):
        t = f" {t.lower()} "
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    def kernel(x, y):
        return len(grams(x) & grams(y)) / (len(grams(x)) * len(grams(y))) ** 0.5

    k = np.array([[kernel(x, y) for y in texts] for x in texts])
    values, vectors = np.linalg.eigh(k)
    whiten = vectors / np.sqrt(values)
    features = k @ whiten
    target = np.array([[float(lang == x) for x in "ab"] for lang in langs])
    weights = np.linalg.solve(features.T @ features + 1e-2 * 4 * np.eye(4) / 100, features.T @ target)
    new = np.array([[kernel("abc xyz zzz", y) for y in texts]]) @ whiten @ weights
    assert np.allclose(model.scores(["abc xyz zzz"]), new, atol=1e-5)


def test_empty_tables(spark, table, tmp_path):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table([])
    assert bpe.encode_texts(docs, path, pattern).collect() == []
    assert transport.demux_column(transport.mux_texts(docs), ["doc_id"]).collect() == []
    assert secrets.find_secrets(docs, secrets.fit(secrets.default_samples(docs))).collect() == []
    labelled = table([], "doc_id long, text string, lang string")
    assert langid.identify(labelled, langid.train(labelled)).collect() == []
    assert hosts.filter_urls(table([], "page_id long, url string"), table([], "url string, good int")).collect() == []
    tokenfiles.write_token_files(docs, str(tmp_path / "none"), public_tokenizers.path("word_bpe_49k.json"), 1)
    assert tokenfiles.read_token_files(spark, str(tmp_path / "none")).collect() == []
