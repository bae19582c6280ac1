"""The ten operators against brute force on small, awkward tables."""

import base64
import gzip
import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat_format, kneser_ney, minhash, mixing, ngram_model, packing, quality_rules, simhash, token_orc, tokens, url_filter, warc
from tidemark.llm.common import fresh_path, write_table

WORDS = "the of and river stone lantern house window garden paper winter morning silver copper forest mountain".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "x", "y", "z"]) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empties, blanks, a very long text, copies, near-copies, a repeated row, and columns with names of our own."""
    rng = random.Random(9)
    base = prose(rng, 120)
    texts = [None, "", "  \n\t ", "one", prose(rng, 30_000), base, base, base.replace("river", "lake", 1), base + " more", prose(rng, 60), "É ß ŷ 日本 x́ '!!' a.b, don't", "dup line here\n" * 6, "a b c d e f g h " * 30]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, 7, "k", 1) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id", "en", "s1", 7, "k", 1), (None, None, None, None, 7, "k", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, kept string, n_words int").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.limit(0)


def text_of(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def plain_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_tokenizer())
    return t.encode(text, add_special_tokens=False).ids


# ---- 1


def test_memo_equals_the_library():
    enc = tokens.encoder(tokens.default_tokenizer())
    assert enc.separable
    for text in ["a. b, c.. d.,", "It's x's. ' A<|endoftext|>b. <|STARTOFTEXT|>", "İ É. é, ẞ. \t\x0b\x1c y ź ́q", "", "日本語. テスト, 1,2 a1. 1. don't.", "x́. é, 가 ᅡ. a​, b\x85c d\x1fe", "Word!! THAT*** ÀÉ%%% a×b ÷.", "a.,b .. ,, ..."]:
        assert np.frombuffer(enc.raw(text), "<u4").tolist() == plain_ids(text), text


def test_token_archive(spark, awkward, nothing):
    path = fresh_path(spark, "t")
    token_orc.write_token_archive(awkward, path, tokens.default_tokenizer(), 2)
    got = sorted(token_orc.digest(token_orc.read_token_archive(spark, path)).collect(), key=lambda r: r.start)
    want, at = [], 0
    spark_hash = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    for doc, text in sorted(text_of(awkward), key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1]), r[1])):
        ids = [*plain_ids(text), 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    one = token_orc.read_token_archive(spark, path, doc_ids=[10]).collect()
    assert len(one) == 1 and one[0].ids == [*plain_ids(dict(text_of(awkward))[10]), 2]
    assert token_orc.token_archive_roundtrip(nothing).count() == 0


def test_stripes_have_indexes_and_blooms_and_are_skipped(spark):
    from pyarrow import fs, orc

    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word river stone "), F.col("id").cast("string")).alias("text"))
    path = fresh_path(spark, "stripes")
    token_orc.write_token_archive(docs, path, tokens.default_tokenizer(), 2)
    files = [x.path for x in fs.LocalFileSystem().get_file_info(fs.FileSelector(path.removeprefix("file:"))) if x.path.endswith(".orc")]
    for f in files:
        raw, footer = open(f, "rb").read(), orc.ORCFile(f)
        assert footer.row_index_stride == token_orc.ROW_STRIDE and footer.compression == "ZSTD" and footer.nstripes >= 1
        assert raw.startswith(b"ORC")
    kinds = spark.sparkContext._jvm.org.apache.orc
    reader = kinds.OrcFile.createReader(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]), kinds.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    rows = reader.rows()
    streams = {str(x.getKind()) for x in rows.readStripeFooter(reader.getStripes().get(0)).getStreamsList()}
    assert streams >= {"ROW_INDEX", "BLOOM_FILTER_UTF8"}
    scan = token_orc.read_token_archive(spark, path, doc_ids=[20_001])
    assert "EqualTo(doc_id,20001)" in scan._jdf.queryExecution().toString().partition("PushedFilters: [")[2].partition("]")[0]
    got = scan.collect()
    assert len(got) == 1 and got[0].doc_id == 20_001 and got[0].ids == [*plain_ids("word river stone 20001"), 2]


# ---- 2


class File(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_salvage_of_damaged_archives():
    records = [warc.make_record(f"urn:page:{i}", f"http://x/{i}", f"payload {i} WARC/1.0 ".encode() * (i + 1)) for i in range(12)]
    members = [warc.member(r) for r in records]
    starts = np.cumsum([0, *map(len, members)])
    broken = bytearray(b"".join(members))
    for i in (3, 7, 8):
        broken[starts[i] + len(members[i]) // 2] ^= 0x55
    del broken[-5:]
    found = list(warc.salvage(warc.Source(File(bytes(broken)))))
    assert [f.header["warc-record-id"] for f in found if isinstance(f, warc.Record)] == [f"<urn:page:{i}>" for i in (0, 1, 2, 4, 5, 6, 9, 10)]
    assert sum(f.length for f in found) == len(broken) and all(a.offset + a.length == b.offset for a, b in zip(found, found[1:], strict=False))
    raw = b"".join(records)
    cut = raw.replace(b"payload 4", b"PAYLOAD 4", 1)
    found = list(warc.salvage(warc.Source(File(cut))))
    assert [f.header["warc-record-id"] for f in found if isinstance(f, warc.Record)] == [f"<urn:page:{i}>" for i in range(12) if i != 4]
    assert any(isinstance(f, warc.Gap) and "digest" in f.reason for f in found)
    assert list(warc.salvage(warc.Source(File(b"")))) == [] and isinstance(next(warc.salvage(warc.Source(File(b"junk" * 9)))), warc.Gap)


def test_salvage_of_members_with_many_records_and_mixed_files():
    records = [warc.make_record(f"urn:page:{i}", f"http://x/{i}", random.Random(i).randbytes(3000)) for i in range(12)]
    ids = lambda found: [int(f.header["warc-record-id"].strip("<>").rpartition(":")[2]) for f in found if isinstance(f, warc.Record)]
    read = lambda data: list(warc.salvage(warc.Source(File(data))))

    def covers(found, data):
        return sum(f.length for f in found) == len(data) and all(a.offset + a.length == b.offset for a, b in zip(found, found[1:], strict=False))

    whole = warc.member(b"".join(records))
    assert ids(read(whole)) == list(range(12)) and covers(read(whole), whole)
    spoilt = warc.member(b"".join(records[:4]) + records[4][:-9] + b"junk" + b"".join(records[5:]))
    assert ids(read(spoilt)) == [i for i in range(12) if i != 4] and covers(read(spoilt), spoilt)
    torn = bytearray(whole)
    del torn[len(torn) * 2 // 3 :]
    assert ids(read(bytes(torn)))[:6] == list(range(6)) and covers(read(bytes(torn)), torn)
    mixed = [warc.member(b"".join(records[:3])), b"".join(records[3:5]), warc.member(records[5]), b"noise" * 9, records[6], bytearray(warc.member(records[7])), records[8], warc.member(b"".join(records[9:]))]
    mixed[5][200] ^= 0x55
    data = b"".join(mixed)
    assert ids(read(data)) == [i for i in range(12) if i != 7] and covers(read(data), data)
    long = records[2].replace(b"WARC-Type", b"X-Note: " + b"n" * (3 << 20) + b"\r\nWARC-Type", 1)
    for data in (records[1] + long + records[3], warc.member(records[1] + long + records[3])):
        assert ids(read(data)) == [1, 2, 3] and covers(read(data), data)
    bare = re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", records[1])
    assert ids(read(warc.member(records[0] + bare + records[2]))) == [0, 1, 2]
    assert ids(read(warc.member(records[0] + bare + records[2] + records[3])[:-2])) == [0, 2]


def test_archive_round_trip(spark):
    rows = [(0, "http://a/é\n", "same"), (1, None, "same"), (2, "http://b", None), (3, "http://c", ""), (4, "u", "x" * 300_000), (None, "http://d", "same"), (5, "v", "only"), (1, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    got = sorted((tuple(r) for r in warc.archive_roundtrip(pages).collect()), key=str)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [(i, len((h or "").encode()), digest(h), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows]
    assert got == sorted(want, key=str)
    assert warc.archive_roundtrip(pages.limit(0)).count() == 0
    manifest = warc.write_archives(pages, fresh_path(spark, "w"), least_bytes=5)
    read = warc.read_archives(spark, manifest).filter("record_type = 'revisit'").collect()
    assert read == [] and gzip.decompress(open(manifest.first().path.removeprefix("file:"), "rb").read()).startswith(b"WARC/1.1")


# ---- 3


def naive_best_fit(counts, capacity):
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [b for b in range(len(bins)) if bins[b] >= length]
            if fits:
                bins[min(fits, key=lambda b: bins[b])] -= length
            else:
                bins.append(capacity - length)
    return len(bins), sorted(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 50), 50, 17]) for _ in range(300))
    room, n = defaultdict(lambda: 50), 0
    for length, _, first, per, offset in (plan := packing.best_fit_plan(counts, 50)):
        n = max(n, first)
        assert offset + per * length <= 50
    placed, used = Counter(), defaultdict(list)
    for length in counts:
        mine = [p for p in plan if p[0] == length]
        for rank in range(counts[length]):
            _, start, first, per, offset = next(p for p in reversed(mine) if p[1] <= rank)
            used[first + (rank - start) // per].append((offset + (rank - start) % per * length, length))
            placed[length] += 1
    for spots in used.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
    want_bins, want_rooms = naive_best_fit(counts, 50)
    assert placed == counts and len(used) == want_bins
    assert sorted(50 - sum(x for _, x in s) for s in used.values()) == want_rooms
    del room


def test_packing(awkward, nothing):
    got = packing.pack_digest(awkward, capacity=256).collect()
    ids = defaultdict(Counter)
    for doc, text in text_of(awkward):
        whole = [*plain_ids(text), 0]
        for i, at in enumerate(range(0, len(whole), 256)):
            cut = whole[at : at + 256]
            ids[doc][i, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())] += 1
    mine = defaultdict(Counter)
    bins = defaultdict(list)
    for r in got:
        mine[r.doc_id][r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert mine == ids
    for spots in bins.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 256
    made = packing.sequences(packing.pack(awkward, capacity=256)).collect()
    assert len(made) == len(bins) and all(len(r.ids) <= 256 for r in made)
    assert packing.pack_digest(nothing).count() == 0


# ---- 4


def test_min_max_estimates_and_sketch_bound():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(40):
            pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
            both = int(600 * share)
            a, b = pool[: both + (600 - both) // 2], np.concatenate([pool[:both], pool[both + (600 - both) // 2 :]])
            got.append(minhash.estimate(minhash.signature(a), minhash.signature(b)))
            differ = sum(bin(int(x) & (2**64 - 1)).count("1") for x in minhash.odd_sketch(a) ^ minhash.odd_sketch(b))
            assert differ <= 600 - both
        assert abs(np.mean(got) - share) < 0.02


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_against_all_pairs(spark, awkward, nothing, words):
    rng = random.Random(4)
    base = [rng.choice(WORDS) + str(rng.randint(0, 30)) for _ in range(150)]
    more = []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 30)):
            w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**6)}"
        more.append((100 + i, " ".join(w)))
    docs = awkward.select("doc_id", "text", "kept").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumn("kept", F.lit("x")))
    sets = {}
    for doc, text in text_of(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        sets[doc] = set(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else ({tuple(w)} if w else set())
    known = [d for d in sets if d is not None]
    comp = {d: d for d in known}

    def root(d):
        while comp[d] != d:
            d = comp[d]
        return d

    for i, a in enumerate(known):
        for b in known[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    got = minhash.near_duplicates(docs, words, 80).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)
    kept = minhash.keep_one_of_each(docs, words, 80)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None} | {d for d in known if root(d) == d}
    assert minhash.near_duplicates(nothing).count() == 0


# ---- 5


def test_url_rules_and_parts(spark):
    urls = ["http://a.Example.com/en/7?x", "https://example.com/en/6", "http://x.net/de/1", "http://example.net/de/8", "ftp://o.org/es/", "http://o.org/es", None, "no scheme/en/", "http://com/en/", "http://notexample.com/en/7", "http://e.com?q://x/en/", "http://x.example.net#/de/8", ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r.page_id: r for r in url_filter.judge(pages, url_filter.Model()).collect()}
    rules = dict(url_filter.RULES)
    for i, url in enumerate(urls):
        after = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", after)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", after)[1]
        fits = [r for r in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        rule = max(fits, key=len, default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, rules.get(rule, "allow"))


def test_trees_find_bad_hosts_out_of_sample(spark):
    rng = random.Random(2)
    made = [(f"http://{'casino' if bad else rng.choice(WORDS)}{'-win77' if bad else ''}{rng.randint(0, 99)}.example.{rng.choice(['com', 'net'])}/{'x/' * rng.randint(0, 3)}{rng.randint(0, 999)}", int(bad)) for bad in (rng.random() < 0.3 for _ in range(1500))]
    train, held = made[:1000], made[1000:]
    model = url_filter.fit(spark.createDataFrame(train, "url string, bad int"))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    got = {r.page_id: r.margin > 0 for r in url_filter.judge(pages, model, rules=()).collect()}
    assert np.mean([got[i] == bool(b) for i, (_, b) in enumerate(held)]) > 0.95
    assert url_filter.fit(spark.createDataFrame(train[:0] or [(None, None)], "url string, bad int")).trees == []


# ---- 6


def test_chat_windows(spark):
    rng = random.Random(7)
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-2, 0, "a\\1[/INST", "\\0\\1<s>\\"), (-2, 1, None, None), (-2, 1, "assistant", "x[/INST"), (-2, 1, "assistant", "x[/INST"), (None, None, "user", "y</s")]
    for c in range(12):
        rows += [(c, t, "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2], prose(rng, rng.choice([1, 20, 300]))) for t in range(rng.randint(1, 14))]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("size", F.lit(3)).repartition(3)
    windows = write_table(chat_format.format_windows(turns, 200, 60), "w")
    assert windows.groupBy("conv_id").count().agg(F.max("count")).first()[0] > 1
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((-1 if t is None else t, r or "", x or ""))
    for r in chat_format.digests(windows).collect():
        mine = sorted(by.pop(r.conv_id))
        told, loss = "".join(f"{a}\n{b}\n" for _, a, b in mine), "".join(b for _, a, b in mine if a == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not by
    systems = windows.filter("window > 0 AND conv_id % 2 = 1").select("formatted").collect()
    assert systems and all(x.formatted.startswith("<s>[INST] system [/INST]") for x in systems)
    assert chat_format.format_windows(turns.limit(0)).count() == 0


def test_windows_against_a_plain_loop(spark):
    import regex

    rng = random.Random(17)
    budget, history = 60, 15
    rows = []
    for c in range(25):
        rows += [(c, t, "system" if t == 0 and c % 3 else ("user", "assistant")[t % 2], prose(rng, rng.choice([0, 1, 3, 8, 30])) + rng.choice(["", "日本語 x1234", "<s>"])) for t in range(rng.randint(1, 30))]
    rows += [(100, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5_000)] + [(None, 0, "user", "x"), (None, 1, "assistant", "y " * 200)]
    got = defaultdict(list)
    for r in chat_format.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget, history).collect():
        got[r.conv_id].append((r.window, r.n_repeated, r.n_tokens, r.formatted))
    mark = {x: f"\\{i}" for i, x in enumerate(chat_format.CONTROL, 1)}

    def esc(t):
        t = t.replace("\\", "\\0")
        for x, y in mark.items():
            t = t.replace(x, y)
        return t

    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role, f"[INST] {role} [/INST]{esc(text)}</s>"))
    for c, mine in by.items():
        size = [len(regex.findall(chat_format.TOKEN, w)) for _, w in mine]
        system = size[0] if mine[0][0] == "system" else 0
        starts, base = [0], 0
        for i in range(1, len(mine)):
            room = budget - (system + history if len(starts) > 1 else 0)
            if sum(size[base : i + 1]) > room:
                starts.append(base := i)
        want = []
        for w, (a, b) in enumerate(zip(starts, [*starts[1:], len(mine)], strict=True)):
            keep = 0
            if w:
                room = min(history, budget - system - sum(size[a:b]))
                first = a
                while first - 1 >= (1 if system else 0) and sum(size[first - 1 : a]) <= room:
                    first -= 1
                shown = ([0] if system else []) + list(range(first, a))
                keep = len(shown)
                shown += range(a, b)
            else:
                shown = list(range(a, b))
            n = sum(size[i] for i in shown)
            assert n <= budget or b - a == 1
            want.append((w, keep, n, "<s>" + "".join(mine[i][1] for i in shown)))
        assert sorted(got.pop(c)) == want
    assert not got


# ---- 7


def test_fingerprints_and_next(spark, awkward, nothing):
    docs = awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in simhash.fingerprint_edits(docs).collect()}
    order = sorted(text_of(docs), reverse=True)
    for i, (doc, text) in enumerate(order):
        after_doc, after = order[(i + 1) % len(order)]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (got[doc].n_chars, got[doc].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        apart = bin(int(got[doc].fingerprint, 16) ^ int(got[after_doc].fingerprint, 16)).count("1")
        assert got[doc].near_next == pytest.approx(1 - apart / 128)
    assert got[5].fingerprint == got[6].fingerprint
    assert simhash.fingerprint_edits(nothing).count() == 0 and simhash.fingerprint_edits(awkward).count() == awkward.count()


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(1)
    near = [rng.getrandbits(128) for _ in range(20)]
    prints = [*near, *(b ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, 5))) for b in near for _ in range(6))]
    rows = spark.createDataFrame([(i, f"{p:032x}") for i, p in enumerate(prints)], "doc_id long, fingerprint string")
    distinct = sorted({f"{p:032x}" for p in prints})
    far = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = {(a, b, far(a, b)) for i, b in enumerate(distinct) for a in distinct[:i] if far(a, b) <= 3}
    assert {tuple(r) for r in simhash.near_classes(rows).collect()} == want and want
    got = {tuple(r) for r in simhash.search(rows.filter("doc_id % 50 = 0"), rows).collect()}
    assert got == {(i, f, far(f, f"{prints[i]:032x}")) for i in range(0, len(prints), 50) for f in distinct if far(f, f"{prints[i]:032x}") <= 3}


def test_every_suffix_keeps_its_statistics(spark):
    made = [(f"http://h{j}.s{i:03}/{j}", int((i + j) % 7 == 0)) for i in range(260) for j in range(2 + i % 3)]
    made += made[:9]
    labelled = spark.createDataFrame(made, "url string, bad int")
    model = url_filter.fit(labelled)
    n, b = (Counter(), Counter())
    for url, bad in made:
        host = url.split("/")[2]
        for x in (host[-5:], host):
            n[x] += 1
            b[x] += bad
    total = len(made)
    prior = (sum(x for _, x in made) + 1) / (total + 2)
    rows = url_filter.with_features(url_filter.with_parts(labelled), "url", model.suffix_bad, model.prior).collect()
    assert len(rows) == total
    for r in rows:
        assert r._u_suffix_bad == pytest.approx((b[r.host[-5:]] + 10 * prior) / (n[r.host[-5:]] + 10))
        assert r._u_domain_bad == pytest.approx((b[r.host] + 10 * prior) / (n[r.host] + 10))
    assert url_filter.judge(labelled.withColumn("page_id", F.lit(1)), model).count() == total


def test_margins_are_the_trees_own_and_edge_cases(spark):
    rng = random.Random(21)
    made = [(f"http://{rng.choice(['spam', 'good', 'fine'])}-{rng.randint(0, 50)}.x{rng.randint(0, 3)}.org/{'a/' * rng.randint(0, 5)}?{'&'.join('k=1' for _ in range(rng.randint(0, 4)))}", rng.randint(0, 1)) for _ in range(400)]
    model = url_filter.fit(spark.createDataFrame(made, "url string, bad int"), sample_rows=300)
    assert model.trees
    urls = [None, "", "no scheme", "http://", "http://a/" + "p/" * 200_000, "http://É日本.org/x?y#z", *[u for u, _ in made[:50]], made[0][0]]
    pages = spark.createDataFrame([(None if i % 5 == 0 else i % 7, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("_u_depth", F.lit("mine")).withColumn("verdict", F.lit("mine"))
    rows = url_filter.with_features(url_filter.with_parts(pages.select("page_id", "url")), "url", model.suffix_bad, model.prior).withColumn("margin", model.margin()).collect()
    want = model.predict({f: np.array([r[f"_u_{f}"] for r in rows], float) for f in url_filter.FEATURES})
    assert np.allclose([r.margin for r in rows], want)

    def features(u):
        u = u or ""
        after = u.partition("://")[2]
        host, path = re.match(r"[^/?#]*", after)[0].lower(), re.match(r"[^/?#]*([^?#]*)", after)[1]
        query = (re.search(r"\?([^#]*)", u) or [0, ""])[1]
        share = [host.count(c) / max(len(host), 1) for c in url_filter.ALPHABET]
        return {"url_chars": len(u), "host_chars": len(host), "path_chars": len(path), "depth": path.count("/"), "labels": host.count(".") + 1, "digit_share": len(re.findall("[0-9]", u)) / max(len(u), 1), "hyphens": host.count("-"), "host_entropy": -sum(s * np.log2(s) for s in share if s), "n_parameters": query.count("&") + 1 if query else 0, "longest_label": max(map(len, host.split(".")))}

    for r in rows:
        for k, v in features(r.url).items():
            assert r[f"_u_{k}"] == pytest.approx(v), (k, r.url)
    got = url_filter.judge(pages, model, rules=()).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == sorted((str(r.page_id), "block" if r.margin > 0 else "allow") for r in rows)
    assert url_filter.judge(pages.limit(0), model).count() == 0
    assert url_filter.auc(np.array([0.1, 0.4, 0.35, 0.8]), np.array([False, False, True, True])) == 0.75


# ---- 8


def test_classifier_separates_and_keeps_its_edge_cases(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 80), "en") for i in range(120)] + [(200 + i, " ".join(w.upper() + "!!%%" for w in prose(rng, 40).split()), "en") for i in range(20)] + [(300, None, "en"), (301, "", None), (302, prose(rng, 50), "xx"), (None, prose(rng, 50), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(1)).withColumn("key", F.lit("mine"))
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(200, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert all(got[i].kept for i in range(100, 120)) and not any(got[200 + i].kept for i in range(20))
    assert got[300].perplexity is None and not got[300].kept and got[302].kept and len(got) == len(rows)
    kept = kneser_ney.keep_trusted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0 and kneser_ney.classify(docs, labels.limit(0)).filter("kept").count() == len(rows) - 2


def test_scripts_repeats_and_long_texts(spark, monkeypatch):
    rng = random.Random(12)
    cjk = lambda n: "".join(chr(rng.randint(0x4E00, 0x4E40)) for _ in range(n))
    rows = [(i, cjk(90), "zh") for i in range(60)] + [(100, cjk(20_000), "zh"), (101, "".join(chr(rng.randint(0x9000, 0x9900)) for _ in range(90)), "zh")] + [(i, prose(rng, 50), "en") for i in range(200, 280)]
    rows += [rows[3]] * 5 + [(rows[3][0], cjk(50), "zh"), (400, rows[3][1], "zh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1) for i in [*range(55), *range(200, 270)]], "doc_id long, quality int")
    got = kneser_ney.classify(docs, labels).collect()
    assert len(got) == len(rows) and len({r.perplexity for r in got if r.text_hash == next(x.text_hash for x in got if x.doc_id == 400)}) == 1
    by = {r.doc_id: r for r in got}
    assert by[100].kept and not by[101].kept
    for name, value in (("PIECE_CHARS", 700), ("PACK_CHARS", 900), ("DENSE", 1), ("HELD_NGRAMS", 50)):  # in the driver's process alone
        monkeypatch.setattr(ngram_model, name, value)
    text = rows[60][1]
    at, orders = ngram_model.ngrams([ngram_model.PAD * 4 + text + ngram_model.END])
    names = lambda: (lambda told: [told[i] for i in orders[4][0][at - 4]])(ngram_model._names(orders[4][1]))
    whole = Counter(names())
    parts = Counter()
    for some in ngram_model._pieces([text]):
        at, orders = ngram_model.ngrams([p for _, p in some])
        parts.update(names())
    assert whole == parts and sum(whole.values()) == len(text) + 1


def test_evidence_of_words_and_growth(spark):
    rng = random.Random(8)
    said = ["the river and the stone", "silver morning of winter", "paper lantern house", "copper forest mountain garden"]
    good = lambda: " ".join(rng.choice(said) for _ in range(25))
    shuffled = lambda t: " ".join(rng.sample(t.split(), len(t.split())))
    rows = [(i, good()) for i in range(120)] + [(200 + i, shuffled(good())) for i in range(10)] + [(300 + i, f"{w} " * 90) for i, w in enumerate(WORDS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert not any(got[i].kept for i in range(200, 210)) and not any(got[300 + i].kept for i in range(len(WORDS)))
    assert sum(got[i].kept for i in range(100, 120)) >= 17
    text = docs.filter("doc_id < 100").select(F.lit(0).alias("mk"), "text")
    small, _ = ngram_model.train(text)
    large, _ = ngram_model.train(text.union(text.select("mk", F.translate("text", "aeiou", "uoiea"))))
    assert large.count() > 1.5 * small.count()


def test_scores_equal_a_plain_kneser_ney(spark):
    rng = random.Random(5)
    texts = [prose(rng, 40) for _ in range(30)]
    asked = [prose(rng, 30), "x", "river river river\0\0 unheard \U0001f600", texts[0]]
    order, pad = ngram_model.ORDER, ngram_model.PAD
    grams = lambda t: (lambda w: [w[i : i + order] for i in range(len(w) - order + 1)])(pad * (order - 1) + t + ngram_model.END)
    counts = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def off(k):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        d = [max(0.05, min(i - 0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.75 for i in (1, 2, 3)]
        return lambda c: d[min(c, 3) - 1]

    offs = {k: off(k) for k in counts}
    below = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            below[k][g[:-1]].append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        ns = below[k].get(g[:-1])
        if ns is None:
            return p(g[1:])
        n = counts[k][g]
        return ((n - offs[k](n) if n else 0) + sum(map(offs[k], ns)) * p(g[1:])) / sum(ns)

    letters = [*counts[1], "never"]
    for context in (texts[0][:4], pad * 4, "zzzz"):
        assert sum(p(context + x) if x != "never" else p(context + "\0") for x in letters) == pytest.approx(1)
    model, told = ngram_model.train(spark.createDataFrame([(3, t) for t in texts], "mk int, text string"))
    rows = spark.createDataFrame([(i, 1, 1, t) for i, t in enumerate([*asked, asked[0]])] + [(9, 1, 1, ""), (10, 5, 0, "x")], "tid long, key int, fold int, text string").repartition(2)
    got = {r.tid: r.perplexity for r in ngram_model.perplexity(rows, model, told, 2).collect()}
    for i, t in enumerate([*asked, asked[0]]):
        assert got[i] == pytest.approx(np.exp(-np.mean([np.log(p(g)) for g in grams(t)])), rel=1e-6)
    assert got[9] is None and got[10] is None and got[0] == got[4]


def test_threshold_is_the_quantile_of_trusted_documents(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 30), "en") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = kneser_ney.classify(docs, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).collect()
    trusted = sorted(r.perplexity for r in got if r.doc_id < 40)
    assert {r.threshold for r in got} == {trusted[-1]} and all(r.kept == (r.perplexity <= trusted[-1]) for r in got)


# ---- 9


def test_knapsack_is_exact():
    rng = random.Random(6)
    for _ in range(200):
        items = [(rng.randint(1, 30), rng.randint(1, 4)) for _ in range(rng.randint(0, 6))]
        items = list(Counter({x: n for x, n in items}).items())
        budget = rng.randint(0, 120)
        sums = {0}
        for x, n in items:
            sums = {s + x * k for s in sums for k in range(n + 1)}
        took = mixing.knapsack(sorted(items, reverse=True), budget)
        assert all(k <= dict(items)[x] for x, k in took.items())
        assert abs(sum(x * k for x, k in took.items()) - budget) == min(abs(s - budget) for s in sums)


def test_mix(spark, awkward, nothing):
    rng = random.Random(8)
    extra = [(1000 + i, prose(rng, rng.randint(5, 80)), rng.choice(["b", "B", "a", "é"])) for i in range(400)]
    docs = awkward.select("doc_id", "text", "source", "size").unionByName(spark.createDataFrame(extra, "doc_id long, text string, source string").withColumn("size", F.lit(1)))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sizes, source = defaultdict(int), {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += n
        source[r.doc_id] = r.source
    goal = mixing.targets(sizes)
    assert sum(goal.values()) == pytest.approx(sum(sizes.values())) and all(goal[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        if r.doc_id is not None:
            assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
            taken[source[r.doc_id]] += r.taken
    for s in ("B", "a", "b", "é"):
        assert abs(taken[s] - goal[s]) <= 1
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(1 for _ in mixed.collect())
    assert Counter(r.doc_id for r in mixed.collect() if r.doc_id and r.doc_id >= 1000) == Counter({r.doc_id: r.taken // r.size for r in rows if r.doc_id and r.doc_id >= 1000 and r.taken})
    assert mixing.mix(nothing).count() == 0


def test_nearest_sum_of_any_budget_is_exact():
    rng = random.Random(16)
    for trial in range(300):
        unit = rng.choice([1, 1, 2, 7])
        items = list({unit * rng.randint(1, 25): rng.randint(1, 6) for _ in range(rng.randint(0, 7))}.items())
        size = sum(x * n for x, n in items)
        budget = rng.randint(0, size + 3)
        sums = {0}
        for x, n in items:
            sums = {s + x * k for s in sums for k in range(n + 1)}
        took = mixing.nearest_sum(items, budget, first_words=rng.choice([1, 3, 20]))
        assert all(0 < k <= dict(items)[x] for x, k in took.items())
        assert abs(sum(x * k for x, k in took.items()) - budget) == min(abs(s - budget) for s in sums), (trial, items, budget)
    many = [(x, 1 + x % 5) for x in range(2, 3000)]
    budget = sum(x * n for x, n in many) * 2 // 3 + 1
    assert sum(x * k for x, k in mixing.nearest_sum(many, budget).items()) == budget


def test_repeated_rows_meet_the_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 64)
    same = "one two three four five six seven"
    rows = [(None, same, "a")] * 1000 + [(7, same, "b")] * 900 + [(1000 + i, prose(random.Random(i), 9), "c") for i in range(600)] + [(5, None, "a"), (6, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine")).withColumn("m", F.create_map(F.lit("k"), F.lit(1))).repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    size = {"a": 7000, "b": 6300, "c": 5400}
    goal = mixing.targets(size)
    for s, n in size.items():
        mine = [r for r in got if r.source_size == n]
        assert abs(sum(r.taken for r in mine) - goal[s]) <= (3.5 if s != "c" else 4.5) and all(r.taken <= 3 * r.size for r in mine)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken // r.size if r.size else 0
    assert Counter(r.doc_id for r in mixed.collect() if (r.text or "").strip()) == +want


def test_targets_order_sources_by_code_point():
    got = mixing.targets({"b": 1000, "B": 1000, "é": 1000, None: 1000})
    assert got["B"] == pytest.approx(4000 * 5 / 13) and got[None] == pytest.approx(4000 * 5 / 13) and got["b"] == pytest.approx(4000 * 2 / 13)
    assert mixing.targets({"a": 10, "b": 1000})["a"] == 30 and mixing.targets({"a": 10, "b": 1000})["b"] == pytest.approx(980)


# ---- 10


def test_rule_statistics(awkward, nothing):
    got = sorted((tuple(r) for r in quality_rules.judge(awkward, []).collect()), key=str)
    want = []
    for doc, text in text_of(awkward):
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        want.append((doc, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed, 0, not failed))
    assert got == sorted(want, key=str)
    assert quality_rules.judge(nothing, []).count() == 0


def test_learned_list_and_filter(spark):
    rng = random.Random(5)
    good = [(i, prose(rng, rng.randint(25, 80)), 1) for i in range(300)]
    bad = [(1000 + i, " ".join(w + "%%%" for w in prose(rng, 60).split()), 0) for i in range(90)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, quality int").withColumn("kept", F.lit("mine")).cache()
    labels = docs.select("doc_id", "quality").filter("doc_id % 2 = 0")
    rules = quality_rules.fit(docs, labels)
    assert rules
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs, rules).collect()}
    assert np.mean([got[d] for d, _, _ in good]) > 0.97 and not any(got[d] for d, _, _ in bad)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, k in got.items() if k}
    assert quality_rules.fit(docs, labels.filter("quality = 1")) == []


# ---- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("kept", F.lit(0))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = write_table(stage(spark, seen, sf), name)
        assert out.columns == docs.columns
        seen = out
    left = {r.doc_id for r in seen.collect()}
    assert all(stage(spark, docs.limit(0), sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
    assert not [d for d in left if labels.get(d) == 0] and len(left) > 100
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, sf)
    assert packed.select("doc_id").distinct().count() == len(left)


def test_stages_against_plain_loops(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    awkward = spark.createDataFrame([(None, None, None, None, None), (None, "river stone " * 40, "en", None, 480), (3, "", "en", "src1", 0)], docs.schema)
    seen, rows = docs.unionByName(awkward).unionByName(docs.limit(4)).withColumn("size", F.lit("mine")).withColumn("_id", F.lit(1)), []
    for name, stage in corpus_pipeline.STAGES:
        out = write_table(stage(spark, seen, sf), name)
        rows.append([(r.doc_id, r.text if "text" in out.columns else None, r.source if "text" in out.columns else None, r) for r in out.collect()])
        if name != "best_fit_packing":
            assert out.columns == seen.columns
        seen = out
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for _, text, _, _ in rows[1]:
        w = words(text)
        found = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if found[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        assert len(w) >= 20 and 100 * len(again) <= 30 * len(w)
    sets = {}
    for d, text, _, _ in rows[1]:
        if d is not None:
            w = words(re.sub("[A-Z]+", lambda m: m[0].lower(), text))
            sets[d] = set(zip(*(w[i:] for i in range(5)), strict=False))
    left = {d: d for d in sets}

    def root(d):
        while left[d] != d:
            d = left[d]
        return d

    known = sorted(sets)
    for i, a in enumerate(known):
        for b in known[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and (ra := root(a)) != (rb := root(b)):
                left[max(ra, rb)] = min(ra, rb)
    assert {d for d, *_ in rows[2] if d is not None} == {d for d in known if root(d) == d}
    before, after = Counter(), Counter()
    for _, text, source, _ in rows[2]:
        before[source] += len(words(text))
    for _, text, source, _ in rows[3]:
        after[source] += len(words(text))
    goal = mixing.targets(dict(before))
    longest = max(len(words(t)) for _, t, _, _ in rows[2])
    assert all(abs(after[s] - goal[s]) <= longest for s in before)
    pieces = Counter()
    for _, _, _, r in rows[4]:
        pieces[r.doc_id] += r.length
    assert pieces == sum((Counter({d: len(plain_ids(text)) + 1}) for d, text, *_ in rows[3]), Counter())


def test_registered_queries_on_their_tables(spark):
    from tidemark.llm import queries

    sf = "/root/testdata/sf0.001"
    chats = {r.conv_id: r for r in queries.op6_chat_windows(spark, sf).collect()}
    said = "</s>[INST] ok [/INST]"
    assert (chats[-1].n_turns, chats[-1].loss_chars, chats[-1].loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert len(chats) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for query in (queries.op1_token_orc, queries.op7_simhash, queries.op9_mix_sources, queries.op10_quality_rules):
        assert query(spark, sf).count() == n


def test_votes_of_fingerprints(spark):
    import struct

    rng = random.Random(30)
    texts = [prose(rng, n) for n in (1, 5, 60, 400)] + ["  Été  日本 ÉTÉ\n a bb", ""]
    got = {r.doc_id: r.fingerprint for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        told = []
        for k in range(2):
            seed, ups, every = xxhash.xxh64_intdigest(struct.pack("<i", k), 42), [0] * 64, 0
            for w in re.split(r"[\x20\x09-\x0D]+", text.lower()):
                weight = 0 if not w else 1 if len(w) <= 4 else min(len(w) - 2, 8) ** 2
                every += weight
                h = xxhash.xxh64_intdigest(w.encode(), seed)
                for b in range(64):
                    ups[b] += weight * (h >> b & 1)
            told.append(sum(1 << b for b in range(64) if 2 * ups[b] > every))
        assert got[i] == "".join(f"{x:016x}" for x in told), text
