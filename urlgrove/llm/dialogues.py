"""Repair of the structure of conversations by an automaton of signatures that share their ends.

A conversation's rows, in order of turn, become a word: a letter a row for role and fault.
All distinct words of all conversations are sorted from their ends and read as a suffix-shared
automaton: words with a common end share its nodes, and each node gets its cost-to-go and
best audit suffix for each state of the grammar once. Only the nodes of the current word
are held (a stack), as sorted words need no others again.

Edits: keep (0), rerole to user or assistant (3), delete (4, required for blank rows and duplicates), insert an
empty user or assistant (3); a truncated row that isn't deleted adds 3. The repaired roles'
initials are ``(s?(ua)+)?``. Of the cheapest audits (initials of the edits in order) the least by ASCII is taken.

A word has fewer than 3 * ``SIZE`` letters: longer conversations are several words, whose nodes are
solved to each state in which a word may end, and 256 neighbours at a time are composed until one is left.
That is exact: of two audits of equal cost over the same rows and states none begins the other, so
the least of the parts make the least of the whole. No task holds a conversation's rows; what a
row holds in the end is the audit, which is part of the result. The digest of a repaired conversation
is a SHA-256 over its rows in order, which can't be split: they pass one task as a sorted stream.

Rows of a conversation are ordered by turn (nulls first), role, the first 64 characters of the text and
two digests of it; equal rows count as one row with copies before anything is sorted, so a large group of
copies is a number. Null roles and texts are one space, as are null numbers in the key that damages a row;
a null conv_id is a conversation of its own. Empty texts are blank; very long texts only pass the digests.
An empty table gives an empty one, and extra columns play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_groups, slices, tidy
from .store import Scratch, pick

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters of a word, and digits by which words of one conversation are composed.
SIZE, RADIX = 64, 8
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role in a state, where the grammar allows it.
NEXT = {("s", START): SYSTEM, **{("u", q): USER for q in (START, SYSTEM, ASSISTANT)}, ("a", USER): ASSISTANT}
WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
ROLES = {"u": "user", "a": "assistant"}
ENDS = (START, ASSISTANT)
#: The letter of a row that must go. Others are s, u, a, o (another role), in upper case if truncated.
GONE = "x"
NULL = " "

Step = tuple[int, str]  # cost and audit


def inserted(q: int, most: int = 2) -> Iterator[tuple[int, int, str]]:
    """States that inserts reach from a state, with cost and audit. More than two never pay."""
    cost, audit = 0, ""
    for _ in range(most + 1):
        yield q, cost, audit
        q = NEXT[WANTED[q], q]
        cost, audit = cost + INSERT, audit + "I"


def steps(letter: str) -> list[dict[int, Step]]:
    """By state: the states to which one row's edit leads, after inserts, each with the least cost and then the least audit."""
    out: list[dict[int, Step]] = []
    for q in range(4):
        to: dict[int, Step] = {q: (DELETE, "D")}  # inserts before a deleted row may as well follow it, and D comes before I
        if letter != GONE:
            fault = TRUNCATED * letter.isupper()
            for p, cost, audit in inserted(q):
                for role, extra, mark in ((letter.lower(), 0, "K"), (WANTED[p], REROLE, "R")):
                    if (role, p) in NEXT:
                        r, found = NEXT[role, p], (cost + extra + fault, audit + mark)
                        to[r] = min(to.get(r, found), found)
        out.append(to)
    return out


STEPS = {x: steps(x) for x in (*"suaoSUAO", GONE)}
#: What follows the last row of a conversation, by state.
CLOSING: list[Step | None] = [min(((cost, audit) for p, cost, audit in inserted(q) if p in ENDS)) for q in range(4)]
#: For words that others follow: an end a state.
OPEN: list[list[Step | None]] = [[(0, "") if q == end else None for q in range(4)] for end in range(4)]


def before(letter: str, rest: list[Step | None]) -> list[Step | None]:
    """Cost-to-go and best audit by state of a node, from those of the node behind its letter."""
    out: list[Step | None] = []
    for to in STEPS[letter]:
        found = [(cost + rest[r][0], audit + rest[r][1]) for r, (cost, audit) in to.items() if rest[r] is not None]
        out.append(min(found) if found else None)
    return out


class Automaton:
    """The nodes of the last word, from its end; words come sorted from their ends."""

    def __init__(self, ends: list[list[Step | None]]):
        self.word, self.nodes, self.made = "", [ends], 0

    def node(self, back: str) -> list[list[Step | None]]:
        """By end: cost-to-go and best audit of the whole word, given from its end."""
        same = 0
        while same < min(len(back), len(self.word)) and back[same] == self.word[same]:
            same += 1
        del self.nodes[same + 1 :]
        for letter in back[same:]:
            self.nodes.append([before(letter, rest) for rest in self.nodes[-1]])
            self.made += 1
        self.word = back
        return self.nodes[-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv (conv_id as text), turn, role, text and copies (0: dropped) of the rows after damage by key."""
    rows = pick(conversations, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NULL))
    fate = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select(said("conv_id").alias("conv"), "turn", F.when(fate == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).alias("copies"))


ORDER = ["conv", "turn", "role", "head", "k1", "k2"]
BLANK = r"[^\x20\x09-\x0D]"


def keyed(rows: DataFrame) -> DataFrame:
    """Add head, k1 and k2, by which rows of one turn and role are ordered and texts told apart."""
    return rows.withColumns({"head": F.substring("text", 1, 64), "k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(2), "text")})


def faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct rows with n (copies), blank, cut (truncated) and later (role and text stood in an earlier turn)."""
    rows = keyed(rows).select(*ORDER, (~F.col("text").rlike(BLANK)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut"), "copies")
    rows = scratch.save(rows.groupBy(*ORDER, "blank", "cut").agg(F.sum("copies").alias("n")), "rows")
    of = ["conv", "role", "k1", "k2"]
    again = rows.where("n > 0 and not blank").groupBy(*of).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    rows = rows.join(scratch.save(again, "again"), of, "left")
    return scratch.save(rows.select(*ORDER, "n", "blank", "cut", (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn")) & ~F.col("blank")).alias("later")), "faults")


def counts(rows: DataFrame) -> DataFrame:
    """gaps, blank, duplicate and truncated of every conversation, those without rows included."""
    n, one = F.col("n"), F.when(F.col("n") > 0, 1).otherwise(0)
    fresh = ~F.col("blank") & ~F.col("later")
    by_turn = rows.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("later"), n).otherwise(n - one)).alias("duplicate"),
        F.sum(F.when(fresh & F.col("cut"), one).otherwise(0)).alias("truncated"),
        F.sum(n).alias("n"),
    )
    there = F.when(F.col("n") > 0, F.col("turn"))
    span = F.max(there) - F.min(there) + 1 - F.count(there)
    return by_turn.groupBy("conv").agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")))


LEGAL = {"su", "ua", "au"}
PART = "conv string, part long, seq long, word string, run long, first string, last string, illegal long"


def words(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """The words of all conversations in order of part and seq; ``run`` is a number of rows that must go, apart from words."""
    text, number = pa.string(), pa.int64()
    schema = pa.schema([(name, text if kind == "string" else number) for name, kind in (c.split() for c in PART.split(", "))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[dict] = []
        now: dict | None = None

        def put(row: dict, initial: str, letters: str, n: int) -> None:
            """``letters`` (or a run of ``n`` rows that go) at the end of the row's conversation."""
            nonlocal now
            if now is None or now["conv"] != row["conv"] or bool(now["run"]) or not letters or len(now["word"]) >= size:
                seq = now["seq"] + 1 if now and now["conv"] == row["conv"] else 0
                if now:
                    out.append(now)
                now = {"conv": row["conv"], "part": part, "seq": seq, "word": "", "run": 0, "first": initial, "last": None, "illegal": 0}
            now["illegal"] += n - 1 + (now["last"] is not None and now["last"] + initial not in LEGAL)
            now["word"], now["run"], now["last"] = now["word"] + letters, 0 if letters else n, initial

        for batch in batches:
            for piece in slices(batch, 2000):
                for row in piece.to_pylist():
                    initial, gone = row["role"][:1], row["n"]
                    if not row["blank"] and not row["later"]:
                        letter = initial if initial in ("s", "u", "a") else "o"
                        put(row, initial, letter.upper() if row["cut"] else letter, 1)
                        gone -= 1
                    if gone > size:
                        put(row, initial, "", gone)
                    elif gone:
                        put(row, initial, GONE * gone, gone)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out.clear()
        if now:
            out.append(now)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        tidy()

    live = rows.where("n > 0").select(*ORDER, "n", "blank", "cut", "later")
    return live.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(run, PART)


def solved(found: DataFrame, ends: list[list[Step | None]]) -> DataFrame:
    """word, costs and audits by end and state (-1 and null: no way), of each distinct word, by the automaton."""
    schema = "word string, costs array<long>, audits array<string>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Automaton(ends)
        for batch in batches:
            for piece in slices(batch, 1000):
                back = piece.column(0).to_pylist()
                flat = [[x for end in tree.node(b) for x in end] for b in back]
                costs, audits = [[-1 if x is None else x[0] for x in f] for f in flat], [[x and x[1] for x in f] for f in flat]
                yield pa.RecordBatch.from_arrays([pa.array([b[::-1] for b in back]), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=["word", "costs", "audits"])
        tidy()

    distinct = found.select(F.reverse("word").alias("back")).distinct()
    return distinct.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(run, schema)


def composed(rows: list[dict]) -> list[dict]:
    """Neighbouring parts of one conversation as one part."""
    rows = sorted(rows, key=lambda r: (r["part"], r["seq"]))

    def matrix(r: dict) -> list[list[Step | None]]:
        if r["run"]:
            return [[(DELETE * r["run"], "D" * r["run"]) if q == end else None for q in range(4)] for end in range(4)]
        return [[(c, a) if c >= 0 else None for c, a in zip(r["costs"][4 * e : 4 * e + 4], r["audits"][4 * e : 4 * e + 4], strict=True)] for e in range(4)]

    whole, illegal = matrix(rows[-1]), rows[-1]["illegal"]
    for r, behind in zip(rows[-2::-1], rows[:0:-1], strict=True):
        own = matrix(r)
        illegal += r["illegal"] + (r["last"] + behind["first"] not in LEGAL)
        whole = [[min(((own[m][q][0] + end[m][0], own[m][q][1] + end[m][1]) for m in range(4) if own[m][q] and end[m]), default=None) for q in range(4)] for end in whole]
    flat = [x for end in whole for x in end]
    return [{"conv": rows[0]["conv"], "part": rows[0]["up"], "seq": rows[0]["along"], "run": 0, "first": rows[0]["first"], "last": rows[-1]["last"], "illegal": illegal, "costs": [-1 if x is None else x[0] for x in flat], "audits": [x and x[1] for x in flat]}]


def audited(found: DataFrame, scratch: Scratch) -> DataFrame:
    """conv, illegal, cost and audit of the conversations that have rows."""
    parts = found.groupBy("conv").agg(F.count("*").alias("parts"), F.max("run").alias("longest"))
    found = scratch.save(found.join(parts, "conv"), "parts")
    alone = found.where("parts = 1 and run = 0")
    whole = scratch.save(solved(alone, [CLOSING]), "whole")
    done = alone.join(whole, "word").select("conv", "illegal", F.element_at("costs", 1).alias("cost"), F.element_at("audits", 1).alias("audit"))
    many = found.where("parts > 1 or run > 0").drop("parts", "longest")
    if many.isEmpty():
        return done
    nodes = scratch.save(solved(many, OPEN), "open")
    # a part is joined with its word's node; a run has none
    many = scratch.save(many.join(nodes, "word", "left").drop("word"), "many-0")
    schema, step = "conv string, part long, seq long, run long, first string, last string, illegal long, costs array<long>, audits array<string>", 0
    while True:
        left = many.groupBy("conv").agg(F.count("*").alias("parts"), F.max("seq").alias("seq")).agg(F.max("parts").alias("parts"), F.max("seq").alias("seq")).first()
        if step and left.parts == 1:
            break
        step += 1
        up, along = (F.col("part"), F.shiftright("seq", RADIX)) if left.seq else (F.shiftright("part", RADIX), F.col("seq"))
        many = scratch.save(map_groups(many.withColumns({"up": up, "along": along}), ["conv", "up", "along"], composed, schema), f"many-{step}")
    ends = [F.struct((F.element_at("costs", 4 * q + 1) + cost).alias("cost"), F.concat(F.element_at("audits", 4 * q + 1), F.lit(audit)).alias("audit")) for q, (cost, audit) in enumerate(CLOSING)]
    ends = [F.when(F.element_at("costs", 4 * q + 1) >= 0, e) for q, e in enumerate(ends)]
    return done.unionByName(many.select("conv", "illegal", F.least(*ends).alias("end")).select("conv", "illegal", "end.cost", "end.audit"))


def edited(head: str, rows: Iterator[tuple[str, str, int]]) -> Iterator[bytes]:
    """The repaired lines ``role:text`` of one conversation, from its audit and rows (role, text, copies) in order."""
    state, at = START, 0

    def inserts() -> Iterator[bytes]:
        nonlocal state, at
        while at < len(head) and head[at] == "I":
            role = WANTED[state]
            state, at = NEXT[role, state], at + 1
            yield f"{ROLES[role]}:".encode()

    for role, text, copies in rows:
        for _ in range(copies):
            yield from inserts()
            mark, at = head[at], at + 1
            if mark != "D":
                initial = WANTED[state] if mark == "R" else role[:1]
                state = NEXT[initial, state]
                yield f"{ROLES[initial] if mark == 'R' else role}:{text}".encode()
    yield from inserts()
    if at != len(head):
        raise ValueError("the audit doesn't fit its conversation")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv and repaired_sha256 of every row of ``audits`` (conv, audit). A conversation passes as a stream; its text isn't held."""
    body = keyed(rows).where("copies > 0").select("conv", F.lit(1).alias("kind"), "turn", "role", "head", "k1", "k2", "text", "copies")
    none, zero = F.lit("").cast("string"), F.lit(0).cast("long")
    heads = audits.select("conv", F.lit(0).alias("kind"), zero.alias("turn"), none.alias("role"), none.alias("head"), zero.alias("k1"), zero.alias("k2"), F.col("audit").alias("text"), F.lit(0).alias("copies"))
    both = heads.unionByName(body).repartition("conv").sortWithinPartitions("conv", "kind", *ORDER[1:]).select("conv", "kind", "role", "text", "copies")

    def flat(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for piece in slices(batch):
                yield from piece.to_pylist()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, out = flat(batches), []
        head = next(rows, None)
        while head is not None:
            after: dict | None = None

            def own() -> Iterator[tuple[str, str, int]]:
                nonlocal after
                for row in rows:
                    if not row["kind"]:
                        after = row
                        return
                    yield row["role"], row["text"], row["copies"]

            digest, n = hashlib.sha256(), 0
            for line in edited(head["text"], own()):
                digest.update((b"\n" if n else b"") + line)
                n += 1
            out.append((head["conv"], digest.hexdigest()))
            head = after
            if len(out) >= 2000 or head is None:
                conv, sha = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"conv": conv, "repaired_sha256": sha})
                out = []
        tidy()

    return both.mapInArrow(run, "conv string, repaired_sha256 string")


def repair(conversations: DataFrame, scratch: Scratch, size: int = SIZE) -> DataFrame:
    """A row for every conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 after the damage."""
    rows = damaged(conversations)
    marked = faults(rows, scratch)
    found = scratch.save(words(marked, size), "words")
    all_convs = counts(marked).join(audited(found, scratch), "conv", "left")
    all_convs = scratch.save(all_convs.fillna({"illegal": 0, "cost": 0, "audit": ""}), "audits")
    out = all_convs.join(repaired(rows, all_convs.select("conv", "audit")), "conv")
    return out.select(F.when(F.col("conv") != NULL, F.col("conv").cast("long")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
