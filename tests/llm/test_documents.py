"""Token counts, similarity join, packing, sharding and WARC bundles against brute force and on odd rows."""

import math
import re
import zlib
from collections import defaultdict
from hashlib import sha1

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medlink.llm import ngram_join, packing, sharding, token_counts, warc
from medlink.llm.common import shared_dir, stored
from medlink.llm.encode import WordEncoder, tokenizer_path

SCHEMA = "doc_id long, text string, key string, label int, rank int, score double, size long, item long"
LONG = " ".join(f"word{i % 701} tail{i % 13}," for i in range(9000))
TEXTS = [
    "the quick brown fox jumps over the lazy dog again and again",
    "the quick brown fox jumps over the lazy dog again and again",
    None,
    "",
    " \n\t ",
    "İstanbul Σας <|endoftext|> don't we'll é é ß $$ 12345\nx y",
    "one two",
    "one two",
    LONG,
    LONG.replace("word7 ", "wird7 ", 3),
]


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "k", 1, 2, 0.5, 3, 4) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(tokenizer_path())


def plain_ids(plain, text):
    return plain.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer(spark, plain):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += [t or "" for t in TEXTS] + ["<|ENDOFTEXT|> A", "a\r\nb\x0bc\x85d e", "ÀÉ×÷ſ ǅ İ i̇", "!!, 's 'S x's", ", a. b., c_. d², e. ", ". x", "é, ñ. ó", "a, ∑. b", "\ud800 z".encode("utf-8", "replace").decode()]
    for coder in (WordEncoder(tokenizer_path()), WordEncoder(tokenizer_path(), max_words=50)):
        for low in range(0, len(texts), 7):
            part = texts[low : low + 7]
            ids, ends = coder.encode(part, 0)
            want = [plain_ids(plain, t) for t in part]
            assert [list(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends)] == [w + [0] for w in want]
            assert coder.lengths(part).tolist() == [len(w) for w in want]


def test_token_counts(spark, docs, plain):
    counts = token_counts.length_counts(token_counts.encoded_lengths(docs))
    lengths = [len(plain_ids(plain, t)) for t in TEXTS]
    rows = {r["n_tokens"]: r for r in token_counts.length_histogram(counts).collect()}
    assert set(rows) == set(lengths)
    for n, r in rows.items():
        assert r["n_docs"] == lengths.count(n)
        assert r["docs_from"] == sum(x >= n for x in lengths)
        assert r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
        assert r["docs_up_to_share"] == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    histogram = token_counts.length_histogram(counts)
    for r in token_counts.at_limits(histogram, [1, 10, 2048, 10**6]).collect():
        c = r["context_limit"]
        assert (r["whole_docs"], r["total_tokens"]) == (sum(x <= c for x in lengths), sum(lengths))
        assert r["truncated_tokens"] == sum(min(x, c) for x in lengths)
    half = token_counts.length_quantiles(histogram, [0.5, 1.0]).collect()
    assert [r["n_tokens"] for r in half] == [sorted(lengths)[math.ceil(len(lengths) / 2) - 1], max(lengths)]
    empty = token_counts.length_counts(token_counts.encoded_lengths(docs.limit(0)))
    assert token_counts.length_histogram(empty).count() == 0
    assert token_counts.at_limits(token_counts.length_histogram(empty), [5]).first()["total_tokens"] == 0


def brute_links(texts, n=5, similarity=0.8):
    sets = {}
    for i, t in texts.items():
        words = re.findall(r"\w+", (t or "").lower())
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            if a != b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if both >= similarity * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                    links[a].add(b)
    return links


def closure(links, names):
    out = {}
    for i in sorted(names):
        todo, seen = [i], {i}
        while todo:
            for b in links[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[i] = min(seen)
    return out


def test_join_on_odd_rows(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_copies(docs).collect()}
    links = brute_links(dict(enumerate(TEXTS)))
    assert got == {i: (c, len(links[i])) for i, c in closure(links, range(len(TEXTS))).items()}
    assert ngram_join.near_copies(docs.limit(0)).count() == 0
    odd = frame(spark, ["a b c d e f", "a b c d e f", "x y z u v w", "a b c d e f"], [3, 3, 3, None])
    rows = sorted((tuple(r) for r in ngram_join.near_copies(odd).collect()), key=str)
    assert rows == sorted([(3, 3, 1), (3, 3, 1), (3, 3, 0), (None, None, 0)], key=str)


def test_join_blocks_lose_no_link(spark, monkeypatch):
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):  # one large group of different near copies, compared over several blocks
        words = list(base)
        words[(k * 7) % 118] = f"edit{k}"
        texts.append(" ".join(words))
    texts += [" ".join(f"other{k}x{i}" for i in range(40)) for k in range(10)]
    want = brute_links(dict(enumerate(texts)))
    for size in (512, 16):
        monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", size)
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.near_copies(frame(spark, texts)).collect()}
        assert got == {i: (c, len(want[i])) for i, c in closure(want, range(len(texts))).items()}


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= ngram_join.MAX_HASHES
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.1, 0.999999, 4)


def check_packing(rows, texts, plain, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = [*plain_ids(plain, texts[i]), 0]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(math.ceil(len(ids) / capacity)))
        for r in pieces:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == r["piece"] * capacity and len(part) == r["length"]
            assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_seq), math.ceil(sum(r["length"] for r in rows) / capacity)


def test_packing(spark, docs, plain, monkeypatch):
    monkeypatch.setattr(packing, "RANGE_ROWS", 40)  # several ranges also for few rows
    for capacity in (2048, 64):
        rows = packing.pack_documents(docs, capacity=capacity).collect()
        check_packing(rows, dict(enumerate(TEXTS)), plain, capacity)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    used, bound = check_packing(packing.pack_documents(table).collect(), texts, plain, 2048)
    assert used <= 1.02 * bound + 1
    twice = frame(spark, ["a b", "a b"], [7, 7])
    assert sorted(r["offset"] for r in packing.pack_documents(twice).collect()) == [0, 3]


def test_tiny_documents_are_bundled(spark, plain):
    texts = {i: "word" for i in range(3000)}
    rows = packing.pack_documents(frame(spark, list(texts.values())), capacity=256).collect()
    used, bound = check_packing(rows, texts, plain, 256)
    assert used <= 1.1 * bound + 1


def test_ranges_match_like_one_sweep():
    """Documents and gaps left in ranges get the pairs of a single stack over everything."""
    left = {0: (1, 2), 1: (0, 1), 2: (2, 0), 3: (3, 1), 4: (1, 0)}
    stack, want = [], []
    for part, (docs, gaps) in left.items():
        for d in range(docs):
            if stack:
                want.append((part, d, *stack.pop()))
        stack += [(part, g) for g in range(gaps)]
    got = [(p, d + k, q, g - k) for p, d, q, g, n in packing.match_ranges(left) for k in range(n)]
    assert got == want


def test_sharding(spark, docs):
    rows = sharding.shard_documents(docs, 24).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in enumerate(TEXTS)
    }
    many = frame(spark, ["x"] * 3000, [*range(2998), 5, None])
    rows = sharding.shard_documents(many, 24).collect()
    assert len(rows) == 3000 and {r["law"] for r in rows} == {"key"}
    for s in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    moved = [r for r in rows if r["grown_shard"] != r["shard"]]
    assert {r["grown_shard"] for r in moved} == {24} and 60 < len(moved) < 200
    assert len({r["shard"] for r in rows if r["doc_id"] == 5}) == 1
    weighted = sharding.shard_documents(many, weights={0: 3.0, 1: 1.0, 2: 0.0}).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] for r in weighted}
    assert set(share) == {0, 1} and 0.7 < share[0] / 3000 < 0.8
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("doc_id"), {0: 0.0})


def test_warc(spark):
    big = "<html>" + "x" * 2000 + "é</html>"
    html = [big, big, None, "", "small", "small", big + " ", "\r\n\r\nWARC/1.1\r\n" * 100, LONG * 3]
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, "z") for i, h in enumerate(html)] + [(1, None, big, "z"), (None, "u", big, "z")],
                                  "page_id long, url string, html string, digest string")
    folder = f"{shared_dir(spark)}/warc"
    index = stored(warc.write_bundles(warc.classify(pages), folder, frame_bytes=3000, bundle_bytes=20_000))
    rows = warc.read_bundles(spark, folder, index).collect()
    assert len(rows) == len(html) + 2
    for r in rows:
        if r["page_id"] is not None:
            data = (html[r["page_id"]] or "").encode()
            assert (r["payload_bytes"], r["payload_digest"]) == (len(data), sha1(data).hexdigest())
    kinds = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"]) for r in rows)
    assert kinds[:4] == [(-1, "revisit", 1), (0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert all(k[1] == "response" for k in kinds[4:])
    for r in index.collect():  # one record through the index
        head, payload = warc.read_record(folder, r["bundle"], r["frame"], r["frame_offset"], r["record_bytes"])
        assert head["WARC-Record-ID"] == f"<{r['record_id']}>"
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert payload == (html[r["page_id"]] or "").encode()
    assert len({r["bundle"] for r in rows}) > 1 and max(r["frame"] for r in rows) > 0
    empty = f"{shared_dir(spark)}/none"
    assert stored(warc.write_bundles(warc.classify(pages.limit(0)), empty)).count() == 0
    with pytest.raises(ValueError):
        warc.read_seek_table(b"no table at the end of this")


def test_equal_bundles_are_kept_apart(spark):
    """One page row in every partition, and often enough in each for several equal bundles."""
    rows = spark.range(0, 240, 1, 4).select(F.lit(7).alias("page_id"), F.lit("http://h").alias("url"), F.lit("x" * 500).alias("html"))
    classified = rows.withColumn("digest", F.sha1("html")).withColumn("refers_to", F.lit(None).cast("long"))
    folder = f"{shared_dir(spark)}/equal"
    index = stored(warc.write_bundles(classified, folder, frame_bytes=3000, bundle_bytes=10_000))
    assert index.count() == 240 and index.select("bundle").distinct().count() > 4
    records = warc.read_bundles(spark, folder, index)
    assert records.count() == 240 and records.select("bundle", "frame", "frame_offset").distinct().count() == 240


def test_packing_needs_no_more_sequences_than_a_plain_best_fit(spark, monkeypatch):
    """Against best fit, largest first, over all open gaps; short and long items, also in many ranges."""
    import bisect
    import random

    for seed, (n, longest), rows in ((1, (600, 2048), 20_000), (2, (900, 300), 50)):
        monkeypatch.setattr(packing, "RANGE_ROWS", rows)
        rng = random.Random(seed)
        lengths = [min(longest, int(rng.paretovariate(0.7) * 20)) for _ in range(n)]
        gaps, used = [], 0
        for length in sorted(lengths, reverse=True):
            at = bisect.bisect_left(gaps, length)
            gap = gaps.pop(at) if at < len(gaps) else 2048
            used += gap == 2048
            bisect.insort(gaps, gap - length)
        items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
        placed = packing.best_fit(items).join(items, "item").groupBy("seq").agg({"length": "sum"}).collect()
        assert all(r[1] <= 2048 for r in placed) and sum(r[1] for r in placed) == sum(lengths)
        assert len(placed) <= 1.02 * used + 1, (len(placed), used)
