"""Rendezvous shards, conversation repair and fill-in-the-middle against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from test_operators import ODD, prose, table

from urlgrove.llm import dialogues as D
from urlgrove.llm import fill_middle as M
from urlgrove.llm import rendezvous as R
from urlgrove.llm import resampling as RS
from urlgrove.llm.queries import op11_rendezvous_shards, op12_conversation_repair, op13_fill_in_middle
from urlgrove.llm.store import Scratch

# fill-in-the-middle


def brute_fim(text, doc_id, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fenwick_descent():
    r = random.Random(1)
    for _ in range(60):
        counts = np.array([r.randint(0, 3) for _ in range(r.randint(1, 40))])
        beside = np.array([r.randint(0, 9) for _ in counts])
        tree, other = M.fenwick(counts), M.fenwick(beside)
        for k in range(1, counts.sum() + 1):
            block = int(np.searchsorted(np.cumsum(counts), k))
            assert M.descend(tree, other, k) == (block, k - counts[:block].sum(), beside[:block].sum())
        at = r.randrange(len(counts))
        M.add(tree, at, 2)
        counts[at] += 2
        assert tree.tolist() == M.fenwick(counts).tolist()


LINES = [*ODD, "\n", "\n\n\n", "a\n", "a\nb", "é\r\n日本\n😀", "x <P> y\nz", "<", "<S\n<\n<M\n", "\n".join(["日本語 é"] * 700), "no end " * 9000, *("\n".join(["é" * (k % 5)] * k) + "\n" * (k % 3) for k in range(1, 40))]


def test_fill_in_middle(spark, tmp_path):
    for text in LINES:  # small blocks: cuts fall on every side of a block's bounds
        for k in range(8):
            assert M.transformed((text or "").encode(), k, 7, 100, 50, block=5)[4].decode() == brute_fim(text or "", k)[4]
    rows = [(k, t, "x", 1) for k, t in enumerate(LINES)] + [(None, "a\nb\nc", "x", 1), (3, "other\ntext", "x", 1), (3, "other\ntext", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t, *_ in rows:
        n, form, p, m, out = brute_fim(t or "", d)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, n, form, p, m, sha(out), sha(t or "")))
    got = [tuple(r) for r in op13_fill_in_middle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    back = M.restore(M.transform(df, rate=60, spm=20)).collect()
    assert sorted((str(r.doc_id), r.restored) for r in back) == sorted((str(d), t or "") for d, t, *_ in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert M.digests(M.transform(df.limit(0))).count() == 0


# rendezvous


def brute_shard(key, weights, seed=11):
    u = {s: (int(hashlib.md5(f"{seed}:{s}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for s in weights}
    return min(weights, key=lambda s: (w := weights[s]) / np.log(u[s]))


def test_rendezvous(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(k, prose(k, 3)) for k in range(100, 700)] + [(None, "n"), (None, None)] + [(5, "hot")] * 400
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, shard string, slot int, offer int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_rendezvous_shards(spark, str(tmp_path)).collect()
    eight = {s: 1.0 for s in range(8)}
    want = collections.Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), brute_shard(d, eight), brute_shard(d, eight | {8: 1.0})) for d, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in got)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, (r.doc_id is not None, r.doc_id or 0, r.text_crc32)))
    for of in slots.values():
        assert [s for s, _ in sorted(of)] == list(range(len(of))) and [k for _, k in sorted(of)] == sorted(k for _, k in of)
    assert R.sharded(df.limit(0), eight, {8: 1.0}, Scratch(spark, "t")).count() == 0


def test_weights_and_moves(spark):
    n = 20_000
    df = spark.range(n).toDF("key")
    weights = {3: 1.0, 5: 2.0, 9: 5.0}
    share = {r.shard: r["count"] / n for r in R.assigned(df, "key", weights).groupBy("shard").count().collect()}
    assert all(abs(share[s] - w / 8) < 0.02 for s, w in weights.items())
    moves = {(r.source, r.target): r.records for r in R.moved(df, "key", weights, weights | {7: 2.0}).collect()}
    assert {t for _, t in moves} == {7} and abs(sum(moves.values()) / n - 0.2) < 0.02  # a fifth of the weight, and only into it
    moves = {(r.source, r.target): r.records for r in R.moved(df, "key", weights, {3: 1.0, 9: 5.0}).collect()}
    assert {s for s, _ in moves} == {5} and sum(moves.values()) == round(share[5] * n)
    moves = {t for r in R.moved(df, "key", weights, weights | {3: 2.0}).collect() for t in [r.target]}
    assert moves == {3}  # more weight draws records, and moves no other
    with pytest.raises(ValueError):
        R.assigned(df, "key", {0: 0.0})


def test_written_shards(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as doc_id", "concat('t', id) as text")
    R.write_shards(df, "doc_id", {0: 1.0, 1: 3.0}, f"{tmp_path}/s", rows_per_file=100)
    back = spark.read.parquet(f"{tmp_path}/s")
    want = {r.doc_id: r.shard for r in R.assigned(df, "doc_id", {0: 1.0, 1: 3.0}).collect()}
    assert {r.doc_id: r["__shard"] for r in back.collect()} == want


# conversations


def after_damage(rows):
    out = collections.defaultdict(list)
    s = lambda v: " " if v is None else v
    for c, t, role, text in rows:
        of = out[c]
        fate = zlib.crc32(f"{s(c)}:{s(t)}".encode()) % 20
        role, text = s(role), s(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        of += [(t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode())
    return {c: sorted(of, key=key) for c, of in out.items()}


def signature(rows):
    """(role, fault) of each row."""
    seen, out = set(), []
    for _, role, text in rows:
        real = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not real else "duplicate" if (role, text) in seen else "truncated" if real[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, fault))
    return out


def brute_audit(sig):
    """Cheapest (cost, audit) by a plain recursion from the end over rows and states."""
    accepts = {"": True, "a": True}
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {}
    for i in range(len(sig), -1, -1):
        states = ["", "s", "u", "a"]
        for q in states:
            found = [(0, "")] if i == len(sig) and accepts.get(q) else []
            if i < len(sig):
                role, fault = sig[i]
                found.append((4 + best[i + 1, q][0], "D" + best[i + 1, q][1]))
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    for to, cost, mark in ((role[:1], 0, "K"), ("u", 3, "R"), ("a", 3, "R")):
                        if (q, to) in moves:
                            c, a = best[i + 1, moves[q, to]]
                            found.append((cost + more + c, mark + a))
            best[i, q] = min(found, default=(10**9, ""))
        for _ in range(3):  # inserts until nothing changes
            for q, to in itertools.product(states, "ua"):
                if (q, to) in moves:
                    c, a = best[i, moves[q, to]]
                    best[i, q] = min(best[i, q], (3 + c, "I" + a))
    return best[0, ""]


def every_audit(sig):
    """All scripts with at most two inserts at a place: cost and audit of the cheapest."""
    found = []
    gaps = ["", "u", "a", "ua", "au"]
    choices = [[("D", "", 4)] + ([] if f in ("blank", "duplicate") else [("K", r[:1], 3 * (f == "truncated")), ("R", "u", 3 + 3 * (f == "truncated")), ("R", "a", 3 + 3 * (f == "truncated"))]) for r, f in sig]
    for edits in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(sig) + 1):
            roles = "".join(ins[k] + edits[k][1] for k in range(len(sig))) + ins[-1]
            if re.fullmatch("(s?(ua)+)?", roles) and all(len(e[1]) == (e[0] != "D") for e in edits):
                audit = "".join("I" * len(ins[k]) + edits[k][0] for k in range(len(sig))) + "I" * len(ins[-1])
                found.append((sum(e[2] for e in edits) + 3 * sum(map(len, ins)), audit))
    return min(found)


def brute_repair(rows):
    sig = signature(rows)
    cost, audit = brute_audit(sig)
    turns = {t for t, *_ in rows if t is not None}
    lines, at, roles = [], 0, ""
    want = lambda: "a" if roles[-1:] == "u" else "u"

    def insert():
        nonlocal at, roles
        while audit[at : at + 1] == "I":
            lines.append({"u": "user:", "a": "assistant:"}[want()])
            roles, at = roles + want(), at + 1

    for _, role, text in rows:
        insert()
        mark, at = audit[at], at + 1
        if mark == "K":
            lines.append(f"{role}:{text}")
            roles += role[:1]
        elif mark == "R":
            lines.append({"u": "user", "a": "assistant"}[want()] + ":" + text)
            roles += want()
    insert()
    assert at == len(audit) and re.fullmatch("(s?(ua)+)?", roles)
    first = [r[:1] for r, _ in sig]
    n = collections.Counter(f for _, f in sig)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_audits_are_the_least_of_all():
    r = random.Random(3)
    roles, fault = ["system", "user", "assistant", "tool", "", "uncle"], ["", "", "truncated", "blank", "duplicate"]
    for n in range(4):
        for _ in range(25 if n == 3 else 60):
            sig = [(r.choice(roles), r.choice(fault)) for _ in range(n)]
            assert brute_audit(sig) == every_audit(sig)
    words = sorted({"".join(r.choice("suaoSUAOx") for _ in range(r.randint(1, 9))) for _ in range(400)})
    tree = D.Automaton([D.CLOSING])
    kind = {"s": "system", "u": "user", "a": "assistant", "o": "other", "x": "user"}
    for back in words:
        sig = [(kind[c.lower()], "blank" if c == "x" else "truncated" if c.isupper() else "") for c in back[::-1]]
        assert tree.node(back)[0][D.START] == brute_audit(sig)
    assert tree.made < sum(map(len, words))  # ends are shared


def conversations():
    r, rows = random.Random(8), []
    said = ["Yes.", "no", "What? ", "", " \t", "So it is!\n", "日本。", "ok. ", "x" * 300 + ".", "y" * 30_000]
    for c in range(150):
        turn = 0
        for _ in range(r.randint(1, 9)):
            role = r.choices(["user", "assistant", "system", "tool", "", None], [6, 6, 2, 1, 0.3, 0.3])[0]
            text = r.choice([r.choice(said), f"line {r.random()}.", None]) if r.random() < 0.4 else f"Words {r.random()}."
            rows.append((c, turn, role, text))
            turn += r.choice([1, 1, 1, 2, 0])
    rows += [(200, t, r.choice(["user", "assistant"]), f"{r.choice('abcdefgh')} {t % 37}.") for t in range(900)]  # a hot one, cut into words
    rows += [(201, None, "user", "Same text.")] * 500 + [(201, 3, "assistant", "Other.")] + [(201, 4, "user", f"Same {k % 70}") for k in range(300)]
    rows += [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (None, None, None, None), (202, None, "user", "C."), (203, 7, "assistant", None), (204, -5, "system", "S."), (204, 5, "user", "U.")]
    gone = [c for c in range(1000, 1200) if zlib.crc32(f"{c}:1".encode()) % 20 == 0]
    return rows + [(c, 1, "user", "Away.") for c in gone]


@pytest.mark.parametrize("size", [64, 3])
def test_conversation_repair(spark, tmp_path, size):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, head string, n int")
    df.repartition(7).write.parquet(f"{tmp_path}/conversations.parquet")
    done = op12_conversation_repair(spark, str(tmp_path)) if size == D.SIZE else D.repair(df, Scratch(spark, "t"), size)
    got = {r.conv_id: tuple(r)[1:] for r in done.collect()}
    want = {c: brute_repair(of) for c, of in after_damage(rows).items()}
    assert len(got) == len(want) == len({c for c, *_ in rows})
    assert {c: (got[c], want[c]) for c in want if got[c] != want[c]} == {}
    assert any(not of for of in after_damage(rows).values())
    if size == D.SIZE:
        assert D.repair(df.limit(0), Scratch(spark, "t")).count() == 0


# resampling


def test_draws_follow_the_weights(spark):
    n, size = 2000, 500
    logs = [0.0, -1.0, -2.0, -4.0]
    rows = spark.createDataFrame([(k, logs[k % 4]) for k in range(4 * n)] + [(10**6 + k, None) for k in range(9)], "name long, log_weight double").repartition(5).persist()
    low, high = 0.0, 10.0
    for _ in range(60):  # inclusion is 1 - exp(-c * weight), c by the size
        c = (low + high) / 2
        low, high = (c, high) if sum(n * (1 - np.exp(-c * np.exp(x))) for x in logs) < size else (low, c)
    seen = []
    for seed in (1, 2):
        drawn = {r.name: r.log_weight for r in RS.gumbel_top(rows, size, seed).where("drawn").collect()}
        assert len(drawn) == size and None not in drawn.values()
        got = collections.Counter(drawn.values())
        for x in logs:
            want = n * (1 - np.exp(-c * np.exp(x)))
            assert abs(got[x] - want) < 4 * np.sqrt(want) + 1
        seen.append(set(drawn))
    assert 0 < len(seen[0] & seen[1]) < size  # another seed, another sample
    mass = sum(n * np.exp(x) for x in logs)
    assert abs(RS.gumbel_top(rows, None, 1).where("drawn").count() - mass) <= 1
    assert RS.gumbel_top(rows, 10**6, 1).where("drawn").count() == 4 * n and RS.gumbel_top(rows, 0, 1).where("drawn").count() == 0
    assert RS.gumbel_top(rows.limit(0), None, 1).where("drawn").count() == 0


def test_weights_and_keys_by_hand(spark):
    import regex
    import xxhash

    r = random.Random(2)
    texts = [None, "", "One, two! three", *(prose(k, 60) for k in range(60)), *(" ".join(r.choice(["ka", "zi", "zo"]) for _ in range(50)) for _ in range(25))]
    labels = [(k, int(k < 63), 0) for k in range(3, len(texts), 2)]
    got = {x.doc_id: x for x in RS.draw(table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=1 << 10).collect()}
    held = {x.id for x in spark.range(len(texts)).where("pmod(xxhash64(id, 9), 5) = 0").collect()}
    buckets, mask = 1 << 10, (1 << 64) - 1

    def grams(text):
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in regex.sub(r"([^\pL\pN\pM_\s]+)", r" \1 ", text or "").split()]
        return [(x >> 32) % buckets for x in h + [((a * 0x9E3779B97F4A7C15 + b) * 0xD6E8FEB86659FD93) & mask for a, b in zip(h, h[1:], strict=False)]]

    raw, target = np.zeros(buckets), np.zeros(buckets)
    good = {k for k, q, _ in labels if q}
    for k, t in enumerate(texts):
        for g in grams(t):
            raw[g] += 1
            target[g] += k in good and k not in held
    prior = (raw + 1e-3) / (raw.sum() + 1e-3 * buckets)
    ratio = np.log((target + 30 * prior * buckets) / (target.sum() + 30 * buckets)) - np.log((raw + 30 * prior * buckets) / (raw.sum() + 30 * buckets))
    weight = {k: sum(ratio[g] for g in grams(t)) for k, t in enumerate(texts)}
    assert all(abs(got[k].weight - w) < 1e-3 for k, w in weight.items())
    order = sorted((got[k].weight for k in good & held), reverse=True)
    bound = order[int(np.ceil(0.998 * len(order))) - 1]
    u = {x.id: x.u for x in spark.range(len(texts)).selectExpr("id", f"(pmod(xxhash64(id, 9), {1 << 52}) + 0.5) / {float(1 << 52)} as u").collect()}
    for k, x in got.items():
        log = min(0.0, x.weight - bound)
        assert abs(x.log_weight - log) < 1e-5 and abs(x.key / 1e6 - (log - np.log(-np.log(float(u[k]))))) < 1e-4
    size = round(sum(np.exp(x.log_weight) for x in got.values()))
    assert sorted(k for k, x in got.items() if x.drawn) == sorted(sorted(got, key=lambda k: -got[k].key)[:size])
