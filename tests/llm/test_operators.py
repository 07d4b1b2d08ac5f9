import collections
import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from urlgrove.llm import byte_bpe, fixity, line_runs, near_duplicates, packing, passages, resampling, topk, training_order
from urlgrove.llm import transport_stream as ts
from urlgrove.llm.components import components
from urlgrove.llm.queries import damaged, vocabulary
from urlgrove.llm.store import Scratch

DOC = "doc_id long, text string, lang string, source string, n_chars long, _gone string, id string"
ODD = [None, "", "  two  spaces \n\n x", "Grüße, <|endoftext|> don't! ÇA", "日本語のテキスト😀 é", "a" * 50_000, "\x00\x1c b _. 12,5."]


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), "x", "y") for k, t in enumerate(texts)], DOC)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "di", "ko", "mu", "ze"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_byte_bpe_is_tiktoken(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = vocabulary("byte_bpe_50k.json")
    rows = byte_bpe.decode(byte_bpe.encode(table(spark, ODD), path, offsets="spans"), path).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = ODD[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r._gone == "x"
        assert [text.encode()[s.byte_start : s.byte_end] for s in r.spans] == [own.decode_single_token_bytes(i) for i in np.frombuffer(r.ids, "<u4").tolist()]
        assert all(text[s.char_start : s.char_end].encode().find(text.encode()[s.byte_start : s.byte_end]) >= 0 for s in r.spans)
    assert byte_bpe.whole_characters(["é".encode()[:1], "é".encode()[1:]]) == ["", "é"]
    assert byte_bpe.encode(table(spark, []), path).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, *(prose(k, 5 + 37 * k) for k in range(60)), prose(1, 42)]
    word = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rows = packing.pack_documents(table(spark, texts), vocabulary("word_bpe_49k.json"), 256).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for k, t in enumerate(texts):
        ids = np.array([*word.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for r in by[k]:
            part = ids[r.piece * 256 : (r.piece + 1) * 256]
            assert (r.start, r.length, r.ids_crc32) == (r.piece * 256, len(part), zlib.crc32(part.tobytes()))
        assert sum(r.length for r in by[k]) == len(ids)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for of in bins.values():
        at = 0
        for offset, length in sorted(of):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(table(spark, []), vocabulary("word_bpe_49k.json")).count() == 0


def test_plan_is_best_fit_decreasing():
    for seed in range(20):
        r = random.Random(seed)
        lengths = sorted((r.randint(1, 30) for _ in range(r.randint(1, 200))), reverse=True)
        rooms: list[int] = []
        for n in lengths:  # the plain algorithm
            fit = min((x for x in rooms if x >= n), default=None)
            if fit is None:
                rooms.append(30 - n)
            else:
                rooms[rooms.index(fit)] = fit - n
        used = collections.Counter()
        for length, _, n, first, per, _ in packing.plan(collections.Counter(lengths), 30):
            for k in range(n):
                used[first + k // per] += length
        assert sorted(30 - v for v in used.values()) == sorted(rooms)


def test_transport_stream(spark):
    for n in (0, 63, 64, 65, 170, 171, 4032, 4096, 4097, 40_000):
        payload = ts.padded("x" * n)[1]
        got = ts.demux(ts.mux(payload))
        assert got["payload"] == payload and not got["lost"] and not got["damaged"] and len(ts.mux(payload)) % 188 == 0
        assert got["pts"] == [3600 * k for k in range(-(-len(payload) // 4096))] and got["access"][0] == 0
    media = ts.mux(ts.padded("x" * 40_000)[1])
    cut = ts.demux(media[: 188 * 10] + media[188 * 11 :])
    assert cut["lost"] == 1 and cut["damaged"] == [0]
    whole, sent = ts.demux(media), [media[k : k + 188] for k in range(0, len(media), 188)]
    twice = ts.demux(b"".join(p * (2 if k in (2, 7, 8, 40) else 1) for k, p in enumerate(sent)))
    assert twice == whole
    assert ts.demux(b"".join(p * (3 if k == 7 else 1) for k, p in enumerate(sent)))["lost"] > 0
    for slip in (media[: 188 * 50 + 60] + media[188 * 50 + 61 :], media[: 188 * 50 + 60] + b"?" + media[188 * 50 + 60 :]):
        got = ts.demux(slip)  # the unit of the slip is lost, no other
        assert got["lost"] == 1 and len(got["damaged"]) == 1 and len(got["pts"]) == len(whole["pts"]) and got["access"] == whole["access"]
    spoilt = ts.demux(media[: 188 * 50] + b"?" + media[188 * 50 + 1 :])  # a sync byte alone
    assert spoilt["lost"] == 1 and len(spoilt["damaged"]) == 1
    assert [ts.demux(x)["payload"] for x in (b"", b"G", b"x" * 500, b"G" * 188)] == [b""] * 4
    # equal first tables without effect, other true ones behind them
    body = b"\xe0\0\xf0\0" + bytes([ts.PRIVATE_STREAM]) + (0xE000 | 0x222).to_bytes(2, "big") + b"\xf0\0"
    moved = b"".join(bytes([ts.SYNC, p[1] & 0x40 | 0x02, 0x22]) + p[3:] for p in sent[2:])
    bad = sent[1][:20] + bytes([sent[1][20] ^ 1]) + sent[1][21:]
    real = ts.psi_packet(ts.PMT_PID, ts.section(2, 1, body))
    assert ts.demux(sent[0] + bad + real + moved)["payload"] == whole["payload"]
    assert ts.demux(sent[0] + bad + sent[1] + b"".join(sent[2:]))["payload"] == whole["payload"]
    rows = ts.digests(ts.read_back(ts.store(table(spark, ODD)))).collect()
    for r in rows:
        n, payload = ts.padded(ODD[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    clash = spark.createDataFrame([(1, "a", 7, "m"), (1, "a", 8, "m"), (1, "b", 9, "m"), (None, None, 9, "m")], "doc_id long, text string, n_bytes int, media string")
    got = [(r.doc_id, r.n_bytes, r.media_sha256) for r in ts.digests(ts.read_back(ts.store(clash))).collect()]
    assert len(got) == 4 and len(set(got)) == 3 and ts.digests(ts.read_back(ts.store(table(spark, [])))).count() == 0


def brute_top(rows, k):
    """A list for each row that asks, over all rows but itself."""
    out = collections.Counter()
    for n, (q, v) in enumerate(rows):
        if q % 20 == 0:
            found = sorted(((int(np.dot(v, w)), -d) for m, (d, w) in enumerate(rows) if m != n and len(w) == len(v)), reverse=True)[:k]
            out.update((q, rank + 1, -d, s) for rank, (s, d) in enumerate(found))
    return out


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(0, 0.2, 8)], 0) for k in range(200)]
    rows += [(200, None, 0), (201, [float("nan")] * 8, 0), (202, [None] * 8, 0), (None, [0.1] * 8, 0), (20, rows[20][1], 0), (203, rows[40][1], 0), (60, rows[61][1], 0), (20, rows[60][1], 0), (7, rows[7][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v, _ in rows if k is not None and k not in (200, 201, 202)]
    got = topk.top_k(topk.integers(df), F.col("vec_id") % 20 == 0, 5, block=64, query_block=4).collect()
    assert collections.Counter(map(tuple, got)) == brute_top(whole, 5)
    two = spark.createDataFrame([(20, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert collections.Counter(map(tuple, topk.search(two).collect())) == {(20, 1, 20, 64 * 32): 2}  # one row answers the other


def test_top_k_of_wide_ranges_and_copies(spark):
    rng = np.random.default_rng(5)
    vec = rng.integers(-100_000, 100_000, (300, 6))  # cells are wider than one, so bounds are not exact
    vec[40:160] = vec[40]  # many copies of one vector
    vec[200:220] = vec[200] + rng.integers(-3, 4, (20, 6))
    vec[::50, 0] = 0
    rows = [(k, v.tolist(), "r", 1) for k, v in enumerate(vec)] + [(300, [5, -7], "r", 1), (301, [1, 1], "r", 1)] + [(41, vec[41].tolist(), "r", 1)] * 3 + [(160, vec[160].tolist(), "r", 1)] * 12
    df = spark.createDataFrame(rows, "vec_id long, vec array<bigint>, row string, dim int")
    got = topk.top_k(df.select("vec_id", "vec"), F.col("vec_id") % 20 == 0, 7, block=50, query_block=8).collect()
    assert collections.Counter(map(tuple, got)) == brute_top([(k, v) for k, v, *_ in rows], 7)
    low, width, cells = topk.approximate(vec[3])
    least, most = topk.bounds(np.array([low]), np.array([width]), np.frombuffer(cells, np.uint8)[None], vec)
    exact = vec @ vec[3]
    assert width > 1 and (least[:, 0] <= exact).all() and (exact <= most[:, 0]).all()
    clash = spark.createDataFrame([], "vec_id long, embedding array<float>, row string, cells binary, query long")
    assert topk.search(clash).count() == 0
    one = spark.createDataFrame([(20, [0.5], "x", None, 1), (3, [1.5], "x", None, 1)], clash.schema)
    assert [tuple(r) for r in topk.search(one).collect()] == [(20, 1, 3, 32 * 96)]


PAGES = "page_id long, url string, html string"


def test_fixity(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}\r\n\r\nWARC/1.0 " + "x" * (k % 7)) for k in range(400)] + [(None, None, None), (500, "ü", "日本語" * 30_000)]
    rows += [(600, "http://copy", "same")] * 50
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES + ", file string, key string")
    a = fixity.archive(pages, per_file=90)
    key = {r.page_id: (r.file, r.key) for r in a.collect()}
    whole = fixity.hashed(a)
    hurt = lambda b: sorted((r.file, r.key) for r in fixity.audit(whole, b).collect())
    assert hurt(fixity.hashed(damaged(a))) == sorted(key[k] for k in range(400) if k % 97 == 13)
    assert hurt(whole) == []

    # a record that a replica lacks is the only one reported, whichever side lacks it, and so is one copy less
    lost = fixity.hashed(a.where("page_id is null or page_id <> 77"))
    got = fixity.audit(whole, lost).collect()
    assert [((r.file, r.key), r.digest_b, r.copies_a, r.copies_b) for r in got] == [(key[77], None, 1, 0)]
    assert [(r.file, r.key) for r in fixity.audit(lost, whole).collect()] == [key[77]]
    few = whole.withColumn("copies", F.expr("if(copies = 50, 49, copies)"))
    assert [((r.file, r.key), r.copies_a, r.copies_b) for r in fixity.audit(whole, few).collect()] == [(key[600], 50, 49)]

    # offsets are those of the stored bytes, and stored bytes give the same leaves
    path = str(tmp_path / "replica")
    fixity.write_files(a, path)
    stored = {f: b"".join(p.read_bytes() for p in (tmp_path / "replica" / f"file={f}").glob("*.txt")) for f in {f for f, _ in key.values()}}
    text = {(r.file, r.key): r.record.encode() for r in a.collect()}
    for r in fixity.leaves(whole).collect():
        assert stored[r.file][r.start : r.end] == text[r.file, r.key] * r.copies
    assert hurt(fixity.read_files(spark, path)) == []


def test_fixity_of_spoilt_files(spark, tmp_path):
    a = fixity.archive(spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}") for k in range(60)], PAGES), per_file=1000)
    fixity.write_files(a, str(tmp_path / "r"))
    (file,) = (tmp_path / "r" / "file=0").glob("*.txt")
    text, order = file.read_bytes(), [r.key for r in a.orderBy("key").collect()]
    hurt = lambda: {r.key for r in fixity.audit(fixity.hashed(a), fixity.read_files(spark, str(tmp_path / "r"))).collect()}
    at = [r.start for r in fixity.leaves(fixity.hashed(a)).orderBy("key").collect()]
    for p in (file.parent).glob(".*.crc"):
        p.unlink()
    file.write_bytes(text[: at[20] + 3] + b"#" + text[at[20] + 4 :])  # the head of record 20 is no head any more
    assert hurt() == {order[20], ""}
    file.write_bytes(text[: at[30] - 6] + b"#" + text[at[30] - 5 :])  # a byte of the text of record 29
    assert hurt() == {order[29]}
    file.write_bytes(text[: at[40] - 9])  # the file ends inside record 39
    assert hurt() == {*order[39:], ""}


def test_fixity_of_empty_tables(spark):
    none = fixity.archive(spark.createDataFrame([], PAGES))
    some = fixity.archive(spark.createDataFrame([(1, "u", "h")], PAGES))
    assert fixity.audit(fixity.hashed(none), fixity.hashed(none)).count() == 0
    assert [(r.copies_a, r.copies_b) for r in fixity.audit(fixity.hashed(none), fixity.hashed(some)).collect()] == [(0, 1)]


def test_training_order(spark):
    for n in (1, 2, 3, 100, 1025):
        assert sorted(training_order.feistel(np.arange(n), n, 5)) == list(range(n))
    texts = [*ODD, *(prose(k, 90) for k in range(30))]
    rows = training_order.materialise(table(spark, texts), vocabulary("word_bpe_49k.json"), 64, 16).collect()
    pieces = packing.tokenize(table(spark, texts), vocabulary("word_bpe_49k.json"), 64).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in rows) == sorted((r.doc_id, r.piece, r.length) for r in pieces)
    assert sorted(r.slot for r in rows) == list(range(len(pieces)))
    assert all(r.shard == r.slot // 16 and r.offset == r.slot % 16 * training_order.stride(64) for r in rows)


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "c").collect()))
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def brute_classes(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(texts)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("limit, block, blocks", [(100, 300, 14), (4, 4, 2), (3, 5, 1)])
def test_near_duplicates(spark, limit, block, blocks):
    r, texts = random.Random(5), [*ODD, "A b", "a  B"]
    for k in range(12):
        base = prose(k, 120).split()
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = "edit%d" % r.randrange(99)
            texts.append(" ".join(w))
    root, sizes = brute_classes(texts)
    got = near_duplicates.near_duplicates(table(spark, texts), limit=limit, block=block, blocks=blocks).collect()
    assert {r.doc_id: (r.component_id, r.n_shingles, r.kept) for r in got} == {k: (root[k], sizes[k], root[k] == k) for k in range(len(texts))}
    if limit == 100:
        kept = near_duplicates.drop_near_duplicates(table(spark, texts))
        assert kept.columns == table(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == sorted({x for x in root})
        assert near_duplicates.near_duplicates(table(spark, [])).count() == 0


def test_resampling_held_out(spark):
    texts = [*ODD, *(prose(k, 80) for k in range(300)), *(prose(k, 80).upper().replace(" ", "!! ") for k in range(40))]
    n = len(ODD)
    labels = spark.createDataFrame([(k, int(k < n + 300), 0, "x") for k in range(n, len(texts), 2)] + [(n, 1, 0, "x"), (None, None, None, None)], "doc_id long, quality int, toxic int, text string")
    kept = {r.doc_id for r in resampling.keep_good(table(spark, texts), labels, buckets=1 << 12).collect()}
    clean, junk = set(range(n, n + 300)), set(range(n + 300, len(texts)))
    assert len(clean - kept) <= 3 and len(junk & kept) <= 2
    assert resampling.resample(table(spark, []), labels).count() == 0
    insults = ["fool", "idiot", "moron"]
    rude = [f"{prose(k, 40)} {insults[k % 3]} {prose(k + 1000, 40)}" for k in range(240)]  # a word must stand in five classes of texts, and this prose has few classes
    texts = [*(prose(k, 80) for k in range(300)), *rude]
    labels = spark.createDataFrame([(k, 1, int(k >= 300)) for k in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in resampling.keep_good(table(spark, texts), labels, buckets=1 << 12, sure=3.0).collect()}
    assert len(kept & set(range(300, 540))) == 0 and len(set(range(300)) - kept) <= 10  # the bound is the least of about 30 held-out texts
    df = spark.createDataFrame([(v,) for v in (-(1 << 62), -5, -5, 0, 3, 1 << 50)], "x long")
    assert [resampling.kth_largest(df, "x", k) for k in range(1, 8)] == [1 << 50, 3, 0, -5, -5, -(1 << 62), None]


def brute_lines(texts):
    seen, gone = set(), set()
    for d, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if x.strip(" ")]
        for p in range(len(lines) - 1):
            pair = (lines[p], lines[p + 1])
            if pair in seen:
                gone |= {(d, p), (d, p + 1)}
            seen.add(pair)
    return gone


def test_line_runs(spark):
    r = random.Random(2)
    texts = [*ODD, "a\na\na\na\nb", "a\n\nb", *("\n".join(r.choice("abcdefghij") * 3 for _ in range(r.randint(0, 12))) for _ in range(40))]
    runs = line_runs.repeated_runs(table(spark, texts), Scratch(spark, "t")).collect()
    got = {(x.doc_id, p) for x in runs for p in range(x.first_line, x.first_line + x.n_lines)}
    assert got == brute_lines(texts)
    left = {x.doc_id: x.text for x in line_runs.delete_runs(table(spark, texts), Scratch(spark, "t")).collect()}
    for d, t in enumerate(texts):
        lines = [x for x in (t or "").split("\n") if x.strip(" ")]
        kept = [x for p, x in enumerate(lines) if (d, p) not in got]
        assert (d not in left) if lines and not kept else [x for x in (left[d] or "").split("\n") if x.strip(" ")] == kept
    assert line_runs.repeated_runs(table(spark, ["one", None]), Scratch(spark, "t")).count() == 0


def test_passages(spark):
    passage, line = prose(900, 60), prose(901, 40).split()
    texts = [*ODD, *(prose(k, 150) for k in range(20))]
    clean = set(range(len(texts)))
    texts += [f"{prose(50 + k, 30 + 7 * k)} {passage} {prose(70 + k, 25)}" for k in range(4)]
    edited = [*line[:20], "other", *line[21:]]
    texts += [prose(90, 20) + "\n" + " ".join(line), prose(91, 20) + "\n" + " ".join(edited)]
    df = table(spark, texts)
    spans = passages.repeated_spans(df, Scratch(spark, "t")).collect()
    found = {d for s in spans for d in (s.doc_id, s.keep_doc_id)}
    assert found == set(range(len(clean), len(texts)))
    left = {r.doc_id: r.text for r in passages.delete_passages(df, Scratch(spark, "t")).collect()}
    assert all(left[d] == texts[d] for d in clean) and sum(passage in t for t in left.values() if t) == 1
    assert left[len(texts) - 1] == prose(91, 20)
    assert passages.repeated_spans(table(spark, []), Scratch(spark, "t")).count() == 0


def test_similar_lines_of_stars_and_chains(spark):
    r, texts, fresh = random.Random(11), [], iter(range(10**6))
    edit = lambda w: [("edit%d" % next(fresh)) if k in at else x for at in [r.sample(range(len(w)), 2)] for k, x in enumerate(w)]
    for k in range(30):  # copies link with the original, not with each other
        base = prose(2000 + k, 100).split()
        texts += [" ".join(w) for w in [base, *(edit(base) for _ in range([2, 5, 9][k % 3]))]]
    base = prose(2100, 100).split()
    texts += [" ".join(w) for w in [base, *(edit(base) for _ in range(150))]]  # more than a block
    for k in range(10):  # each links with the one before
        w = prose(2200 + k, 100).split()
        for _ in range(6):
            texts.append(" ".join(w))
            w = edit(w)
    root, _ = brute_classes(texts)
    units = Scratch(spark, "t").save(passages.paragraphs(table(spark, texts), passages.bands(0.75, 0.99999)), "units").where("line")
    links = passages.similar_lines(table(spark, texts), units, Scratch(spark, "t"), 75)
    of = {x.node: x.root for x in components(links, Scratch(spark, "t"), "c").collect()}
    groups = collections.defaultdict(set)
    for u in units.collect():
        groups[of.get(u.key, u.key)].add(u.doc_id)
    assert {d: min(g) for g in groups.values() for d in g} == dict(enumerate(root))


def test_op5_finds_single_lines(spark, tmp_path):
    from urlgrove.llm.queries import op5_line_dedup

    r = random.Random(4)
    texts = [*ODD, "only", "only", "u1\nlicense\nu2", "u3\n\nlicense\nu4", "x\nx", *("\n".join(r.choice("abcdefghij") * 2 for _ in range(r.randint(0, 9))) for _ in range(30))]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for p, x in enumerate(x for x in (t or "").split("\n") if x.strip(" ")):
            want |= {(d, p)} if x in seen else set()
            seen.add(x)
    got = [(x.doc_id, p) for x in op5_line_dedup(spark, str(tmp_path)).collect() for p in range(x.first_line, x.first_line + x.n_lines)]
    assert sorted(got) == sorted(want)


def test_spent_tables_of_passages_go(spark):
    words = [" ".join(f"w{n}x{k}" for k in range(70)) for n in range(3)]
    texts = [f"{words[0]}\n{words[1]}", f"a b {words[0]} c", f"{words[1]}\n{words[2]}"]
    scratch = Scratch(spark, "t")
    left = {r.doc_id: r.text for r in passages.delete_passages(table(spark, texts), scratch).collect()}
    assert left[0] == texts[0] and "w0x" not in left[1] and "w1x" not in left[2] and words[2] in left[2]
    kept = {p.name for p in Path(scratch.root.removeprefix("file://")).iterdir()}
    assert {"spans", "by-doc"} <= kept and not kept & {"units", "collided", "sets", "left", "rest", "line-members", "again-members", "open-ends", "surroundings", "heads-short", "heads-long"}


def test_passages_go_to_their_ends(spark):
    fresh = iter(range(10**6))
    own = lambda n: [f"own{next(fresh)}" for _ in range(n)]
    texts, want = [], []
    for n in [*range(50, 90, 3), 100]:  # the first of three documents keeps the passage; two passages share a document
        passage = own(n)
        for k in range(3):
            before, after = own(20 + 11 * k), own(25 + 7 * k)
            texts.append(" ".join([*before, *passage, *after]))
            want.append(" ".join([*before, *([] if k else passage), *after]))
    x, y, ends = own(51), own(57), own(19)
    texts += [" ".join(x + ends), " ".join(y + own(30)), " ".join([*y, *x])]
    want += [*texts[-3:-1], ""]
    wide = own(140)  # the middle also stands in an earlier document
    texts += [" ".join([*own(30), *wide[45:95], *own(30)]), " ".join([*own(30), *wide, *own(30)]), " ".join([*ends[:9], *wide, *own(2)])]
    last = texts[-1].split()
    cut = texts[-2].split()
    want += [texts[-3], " ".join(cut[:75] + cut[125:]), " ".join(ends[:9] + last[-2:])]
    left = {r.doc_id: r.text for r in passages.delete_passages(table(spark, texts), Scratch(spark, "t")).collect()}
    assert [" ".join(left[d].split()) for d in range(len(texts))] == want


@pytest.mark.parametrize("size", [1, 2])
def test_line_runs_have_true_sources(spark, size):
    r = random.Random(6)
    texts = ["a\nb\nx", "c\nd\ny", "a\nb\nc\nd", "z\n\nb\nx\nc\nd\ny", *("\n".join(r.choice("abcdefgh") for _ in range(r.randint(0, 9))) for _ in range(30))]
    of = [[x for x in t.split("\n") if x] for t in texts]
    first, want = {}, []
    for d, lines in enumerate(of):
        for p in range(len(lines)):
            for n in range(1, len(lines) - p + 1):
                first.setdefault(tuple(lines[p : p + n]), (d, p))
    for d, lines in enumerate(of):
        done = 0
        for p in range(len(lines)):
            depths = [n for n in (1, 2, 4, 8, 16) if n >= size and p + n <= len(lines) and first[tuple(lines[p : p + n])] < (d, p)]
            if depths:
                sd, sp = first[tuple(lines[p : p + depths[-1]])]
                n = next(k for k in range(len(lines) + 1) if p + k == len(lines) or sp + k == len(of[sd]) or lines[p + k] != of[sd][sp + k])
                start = max(p, done)
                if p + n > done:
                    want.append([d, start, p + n - start, sd, sp + start - p])
                    done = p + n
    got = line_runs.repeated_runs(table(spark, texts), Scratch(spark, "t"), size).collect()
    assert sorted([x.doc_id, x.first_line, x.n_lines, x.source_doc_id, x.source_line] for x in got) == sorted(want)
    assert all(of[x.doc_id][x.first_line : x.first_line + x.n_lines] == of[x.source_doc_id][x.source_line : x.source_line + x.n_lines] for x in got)
