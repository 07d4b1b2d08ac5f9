"""Substring dedup whole and the pipeline's stages, held against plain Python."""

import collections
import random

import numpy as np
from test_operators import ODD, brute_classes, prose, table

import corpus_pipeline
from urlgrove.llm import packing, passages, resampling
from urlgrove.llm.queries import vocabulary
from urlgrove.llm.shingles import word_hashes, words
from urlgrove.llm.store import Scratch


def brute_spans(texts, percent=75, min_line=20):
    """(doc, start, n) by definition: similar lines in components, equal chosen windows, and the words beside them that an earlier document has."""
    tokens = [words(t) for t in texts]
    gone = collections.defaultdict(list)
    lines = []
    for d, t in enumerate(texts):
        at = 0
        for x in (t or "").encode().split(b"\n"):
            n = len(x.split())
            lines += [(d, at, n)] if n >= min_line else []
            at += n
    sets = [{tuple(tokens[d][k : k + 5]) for k in range(at, at + n - 4)} for d, at, n in lines]
    up = list(range(len(lines)))
    root = lambda x: x if up[x] == x else root(up[x])
    for a in range(len(lines)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    first = {}
    for k in range(len(lines)):
        first[root(k)] = min(first.get(root(k), 10**9), lines[k][0])
    for k, (d, at, n) in enumerate(lines):
        if d > first[root(k)]:
            gone[d].append((at, n))
    held = collections.defaultdict(set)  # window -> places
    for d, (at, _) in enumerate(passages.windows([word_hashes(t) for t in tokens])):
        for k in at.tolist():
            held[tuple(tokens[d][k : k + passages.WINDOW])].add((d, k))
    held = {w: of for w, of in held.items() if len({d for d, _ in of}) > 1}
    keep = {w: min(d for d, _ in of) for w, of in held.items()}
    later = collections.defaultdict(list)
    for w, of in held.items():
        for d, k in of:
            if d > keep[w]:
                gone[d].append((k, passages.WINDOW))
                later[d].append((k, w))
    ends = set()
    for of in later.values():
        run = []
        for k, w in [*sorted(of), (10**9, None)]:
            if run and k > run[-1][0] + passages.WINDOW:
                ends |= {(x, -1) for s, x in run if s - run[0][0] < passages.REACH} | {(x, 1) for s, x in run if run[-1][0] - s < passages.REACH}
                run = []
            run.append((k, w))
    near = lambda d, k, side: tokens[d][max(0, k - passages.REACH) : k][::-1] if side < 0 else tokens[d][k + passages.WINDOW : k + passages.WINDOW + passages.REACH]
    for w, side in ends:
        for d, k in held[w]:
            own, most = near(d, k, side), 0
            for e, j in held[w]:
                if e < d:
                    n = 0
                    for x, y in zip(own, near(e, j, side), strict=False):
                        if x != y:
                            break
                        n += 1
                    most = max(most, n)
            if d > keep[w] and most:
                gone[d].append((k - most, passages.WINDOW + most) if side < 0 else (k, passages.WINDOW + most))
    out = []
    for d, spans in gone.items():
        done = None
        for at, n in sorted(spans, key=lambda s: (s[0], -s[1])):
            if done and at <= done[1] + done[2]:
                done[2] = max(done[2], at + n - done[1])
            else:
                done = [d, at, n]
                out.append(done)
    return sorted(map(tuple, out))


def corpus():
    r = random.Random(21)
    shared = [prose(3000 + k, r.randint(33, 120)).split() for k in range(14)]
    texts = [*ODD]
    for k in range(70):
        parts = [prose(4000 + 10 * k + j, r.randint(3, 60)).split() for j in range(r.randint(1, 4))]
        for _ in range(r.randint(0, 2)):
            p = r.choice(shared)
            lo, hi = r.choice([0, 0, 5, 20]), r.choice([0, 0, 7, 15])
            parts.insert(r.randint(0, len(parts)), p[lo : len(p) - hi])
        if r.random() < 0.3:  # a line with few edits
            line = list(shared[r.randrange(4)][:33])
            line[r.randrange(len(line))] = f"edit{k}"
            parts.append(["\n", *line, "\n"])
        texts.append(" ".join(w for p in parts for w in p))
    return [*texts, texts[20], texts[21] + " tail"]


def test_repeated_spans_by_definition(spark):
    texts = corpus()
    got = passages.repeated_spans(table(spark, texts), Scratch(spark, "t"), recall=0.999999).collect()
    want = brute_spans(texts)
    assert len(want) > 40 and sorted((r.doc_id, r.start, r.n_words) for r in got) == want


def test_passages_that_repeat_themselves(spark):
    """Spans by definition, and rows beside open ends that follow the passages' number and not their words."""
    r, counts = random.Random(33), []
    many = [[f"r{p}x{k}" for k in range(p)] for p in (1, 2, 3, 5, 9, 18, 19)]
    texts = []
    for k in range(90):
        parts = []
        for _ in range(r.randint(1, 3)):
            p, n, at = r.choice(many), r.randint(30, 130), r.randrange(19)
            parts += [[f"o{r.randrange(4)}"] * r.randint(0, 2), [p[(at + j) % len(p)] for j in range(n)], prose(5000 + r.randrange(40), r.randint(1, 30)).split()]
        texts.append(" ".join(w for p in parts for w in p))
    got = passages.repeated_spans(table(spark, texts), Scratch(spark, "t"), recall=0.999999).collect()
    assert len(got) > 40 and sorted((x.doc_id, x.start, x.n_words) for x in got) == brute_spans(texts)
    for n in (100, 400):
        scratch = Scratch(spark, "t")
        texts = [" ".join([prose(6000 + k, 20), *(["to", "be"] * n), prose(7000 + k, 20)]) for k in range(12)]
        spans = passages.repeated_spans(table(spark, texts), scratch).collect()
        assert sorted((x.doc_id, x.start, x.n_words) for x in spans) == brute_spans(texts)
        counts.append(spark.read.parquet(scratch.path("around")).count())
    assert counts[0] == counts[1] <= 12 * 2 * 4


def test_windows_of_many_texts_are_those_of_each():
    r = random.Random(5)
    texts = [np.array([r.randrange(1 << 62) for _ in range(n)], np.uint64) for n in [0, 1, 31, 32, 33, 49, 50, 51, 400, 50, 32, 1000]]
    for (at, keys), h in zip(passages.windows(texts), texts, strict=True):
        (alone,) = passages.windows([h])
        assert np.array_equal(at, alone[0]) and np.array_equal(keys, alone[1])
        w = passages.window_hashes(h)
        runs = min(19, len(w))
        assert at.tolist() == sorted({s + j for s in range(len(w) - runs + 1) for j in range(runs) if w[s + j] == w[s : s + runs].min()} if runs else [])


def test_pipeline_by_stages(spark, tmp_path):
    """Each stage over its predecessor's rows: the draw, lines, near-duplicates and passages by brute force, then the packed ids."""
    r = random.Random(9)
    texts = corpus()
    texts += [t + " one" for t in texts[10:16]] + ["\n".join(r.choice(["rights reserved", "see below", prose(k, 9)]) for _ in range(5)) for k in range(30)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 5 > 0), 0) for k in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(enumerate(texts))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = Scratch(spark, "stage").save(stage(spark, docs, str(tmp_path)), "out")
        got = {x.doc_id: x.text for x in out.collect()}
        assert out.columns == docs.columns
        ids = sorted(left)
        if name == "quality classifier":
            drawn = {x.doc_id for x in resampling.draw(docs, labels).where("drawn").collect()}
            want = {d: left[d] for d in ids if d in drawn}
        elif name == "line dedup":
            seen, want = set(), {}
            for d in ids:
                lines = [x for x in (left[d] or "").split("\n")]
                kept = [x for x in lines if not x.strip(" ") or not (x in seen or seen.add(x))]
                own = [x for x in lines if x.strip(" ")]
                if not own or any(x.strip(" ") for x in kept):
                    want[d] = kept
            assert set(got) == set(want)
            assert all([x for x in (got[d] or "").split("\n") if x.strip(" ")] == [x for x in want[d] if x.strip(" ")] for d in want)
            want = None
        elif name == "near-duplicates":
            root, _ = brute_classes([left[d] for d in ids])
            want = {d: left[d] for k, d in enumerate(ids) if root[k] == k}
        else:
            by = collections.defaultdict(list)
            for k, at, n in brute_spans([left[d] for d in ids]):
                by[ids[k]].append({"start": at, "n_words": n})
            want = {d: passages.cut(left[d], by[d]) if by[d] and left[d] else left[d] for d in ids}
            assert any(by.values())
        assert want is None or got == want, name
        docs, left = out, got
    pieces = packing.tokenize(docs, vocabulary("word_bpe_49k.json"), 2048).collect()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.piece, p.length, p.ids_crc32) for p in packed) == sorted((p.doc_id, p.piece, p.length, p.ids_crc32) for p in pieces)
    assert {p.doc_id for p in packed} == set(left)


def test_stages_on_nulls_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, version long, key string, drawn boolean, cut_doc int, GONE_DOC int"
    rows = [(d, t, "en", "s", None, 1, "k", True, 2, 3) for d, t in [(1, None), (2, ""), (None, "no id at all"), (None, None), (3, prose(1, 70)), (3, prose(1, 70)), (3, prose(2, 70)), (9, prose(1, 70))]]
    for n in (len(rows), 0):
        path = f"{tmp_path}/{n}"
        spark.createDataFrame(rows[:n], schema).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        out = corpus_pipeline.run(spark, path).collect()
        ids = {r.doc_id for r in out}
        assert ids == ({None} | ids if n else set()) and (not n or 9 not in ids)  # 9 is a copy of 3
