"""Repair of damaged conversations by a rank-convergent parallel Viterbi search.

Rows of a conversation are in order of their turns (nulls first; rows of one turn by role, then by the SHA-256 of the text). A row's first
fault counts: blank, duplicate (role and text seen earlier), truncated (its last character but white space ends no sentence). Edits: Keep costs 0,
Rerole to user or assistant 3, Delete 4 (blank and duplicate rows must go), Insert an empty user or assistant row 3; a truncated row that stays adds 3. What is
left must have role initials ``(s?(ua)+)?``. Of the cheapest edits those count whose initials, in order, are least.

Four states say what the rows so far end with (nothing, system, user, assistant). The cost of the rest of a conversation is a vector over them,
computed backward row by row. A conversation of any length is cut into chunks of up to ``2 ** BITS`` consecutive rows, each a row of its own in Spark:

1. every chunk runs backward from a speculative vector, but for last chunks, whose end is known;
2. fix-up: chunks that aren't last run again from the other vectors that may come, each until it differs from the speculative
   run's by a constant only, from where on both agree (there are 30 vectors but for constants, so one pass settles every case);
3. the vectors at the chunks' borders are stitched together, last to first, and every chunk traces the least edits forward from each state it may
   be entered in; the states are stitched, first to last, and the edits follow.

Only borders (a few hundred bytes for each chunk) are gathered for a conversation, never its rows.

Defined cases: a null role or text is one space; a null conversation is one conversation, null turns are one place before all others;
an empty role, and any other initial than s, u and a, fits nowhere; repeated rows are duplicates; an empty text is blank; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored

BITS = 17
WHITE = " \t\n\x0b\x0c\r"
NEVER = 1 << 40

#: What a kept row does to a state (0 nothing, 1 system, 2 user, 3 assistant), by its initial: s, u, a or another.
_KEEP = [{0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {}]
#: The state after the row that a state asks for, when it is inserted or a row's role is set.
_FILL = [2, 2, 3, 2]
_ROLE = {2: "u", 3: "a"}
#: A row is one letter: its initial's number, plus 4 if truncated, plus 8 if it must go.
LETTERS = "ABCDEFGHIJKL"


def _with_inserts(v: list[int]) -> list[int]:
    user, assistant = min(v[2], 3 + v[3]), min(v[3], 3 + v[2])
    return [min(v[0], 3 + user), min(v[1], 3 + user), user, assistant]


def _before(after: tuple[int, ...], letter: int) -> tuple[tuple[int, ...], int]:
    """Costs before a row from those after it, less their least, and that least."""
    initial, fault = letter % 4, letter // 4
    if fault == 2:
        return after, 4
    more = 3 * fault
    v = [min(4 + after[x], 3 + more + after[_FILL[x]], more + after[_KEEP[initial][x]] if x in _KEEP[initial] else NEVER) for x in range(4)]
    v = _with_inserts(v)
    return tuple(x - min(v) for x in v), min(v)


END = tuple(_with_inserts([0, NEVER, NEVER, 0]))
SPECULATIVE = (0, 0, 0, 0)


def _closure() -> tuple[list[tuple[int, ...]], list[list[tuple[int, int]]]]:
    """All vectors that may come, and for each and each row letter the number of the one before and the cost added."""
    vectors, steps = [END, SPECULATIVE], []
    for v in vectors:  # grows meanwhile
        own = []
        for letter in range(12):
            w, added = _before(v, letter)
            if w not in vectors:
                vectors.append(w)
            own.append((vectors.index(w), added))
        steps.append(own)
    return vectors, steps


VECTORS, STEPS = _closure()


def _backward(letters: bytes, end: int) -> tuple[list[int], int]:
    """The vectors' numbers before each row and after the last, and the cost added from the last to the first."""
    at, total = [end], 0
    for c in reversed(letters):
        end, added = STEPS[end][c - 65]
        at.append(end)
        total += added
    return at[::-1], total


def fix_up(letters: bytes, run: list[int], total: int, end: int) -> tuple[int, int, int]:
    """As the speculative ``run``, from another end: the first vector, the cost added, and how many rows were run again."""
    n, own = len(letters), 0
    added_by_run = 0
    for k in range(n, -1, -1):
        if run[k] == end:  # they differ by a constant: the rest of the run holds
            return run[0], own + total - added_by_run, n - k
        if k:
            c = letters[k - 1] - 65
            added_by_run += STEPS[run[k]][c][1]
            end, added = STEPS[end][c]
            own += added
    return end, own, n


def _choice(letter: int, before: int, after: int, x: int) -> tuple[str, int]:
    """The least of the cheapest edits of a row in state x: rows inserted before it (u, a), then K, D, or U or A for a role set; and the next state."""
    v, w, added, done = VECTORS[before], VECTORS[after], STEPS[after][letter][1], ""
    initial, fault = letter % 4, letter // 4
    more = 3 * fault
    while True:
        if 4 + w[x] == v[x] + added:
            return done + "D", x
        if fault < 2 and 3 + v[_FILL[x]] == v[x]:
            x = _FILL[x]
            done += _ROLE[x]
        elif x in _KEEP[initial] and more + w[_KEEP[initial][x]] == v[x] + added:
            return done + "K", _KEEP[initial][x]
        else:
            x = _FILL[x]
            return done + _ROLE[x].upper(), x


_CHOICES: dict[tuple[int, int, int, int], tuple[str, int]] = {}


def _forward(letters: bytes, run: list[int], x: int, last: bool) -> tuple[str, int]:
    """The edits of a chunk entered in state x, and the state it is left in."""
    codes = []
    for k, c in enumerate(letters):
        key = c - 65, run[k], run[k + 1], x
        if key not in _CHOICES:
            _CHOICES[key] = _choice(*key)
        code, x = _CHOICES[key]
        codes.append(code)
    if last:
        while END[x]:
            x = _FILL[x]
            codes.append(_ROLE[x])
    return "".join(codes), x


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Steps 1 and 2: for each end that may come, the first vector of a chunk and the cost it adds; and its own count of illegal neighbours."""
    legal = {(0, 1), (1, 2), (2, 1)}
    for b in batches:
        out = []
        for text, last in zip(b.column("letters").to_pylist(), b.column("last").to_pylist(), strict=True):
            letters = text.encode()
            run, total = _backward(letters, 0 if last else 1)
            ends = [(run[0], total)] if last else [fix_up(letters, run, total, e)[:2] for e in range(len(VECTORS))]
            kinds = [(c - 65) % 4 for c in letters]
            out.append({"heads": [h for h, _ in ends], "added": [a for _, a in ends], "illegal": sum(x not in legal for x in zip(kinds, kinds[1:])), "first_kind": kinds[0], "last_kind": kinds[-1]})
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("chunk"), b.column("last"), *[pa.array([o[k] for o in out], t) for k, t in zip(("heads", "added", "illegal", "first_kind", "last_kind"), (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()), strict=True)]], ["c", "chunk", "last", "heads", "added", "illegal", "first_kind", "last_kind"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3: the state in which each chunk is left, for each state it may be entered in."""
    for b in batches:
        out = []
        for text, end, last in zip(b.column("letters").to_pylist(), b.column("end").to_pylist(), b.column("last").to_pylist(), strict=True):
            run, _ = _backward(text.encode(), end)
            out.append([_forward(text.encode(), run, x, last)[1] for x in range(4)])
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("chunk"), pa.array(out, pa.list_(pa.int32()))], ["c", "chunk", "exits"])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, end, last, entry in zip(*[b.column(c).to_pylist() for c in ("letters", "end", "last", "entry")], strict=True):
            out.append(_forward(text.encode(), _backward(text.encode(), end)[0], entry, last)[0])
        yield pa.RecordBatch.from_arrays([b.column("c"), b.column("chunk"), b.column("start"), pa.array(out, pa.string())], ["c", "chunk", "start", "codes"])


def _stitched(chunks: DataFrame, own: str, reverse: bool, first: int, step) -> DataFrame:
    """What each chunk of a conversation gets from its neighbour: ``step(table of the neighbour, what that got)``, folded over the conversation."""
    kind = chunks.schema["c"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, parts in enumerate(b.column("parts").to_pylist()):
                got, value = [], first
                for p in reversed(parts) if reverse else parts:
                    got.append((p["chunk"], value))
                    value = step(p[own], value)
                yield pa.RecordBatch.from_arrays([b.column("c").take(pa.array([r] * len(got))), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int32())], ["c", "chunk", "value"])

    parts = chunks.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("chunk", own))).alias("parts"))
    return parts.mapInArrow(fold, f"c {kind}, chunk bigint, value int")


def _meets(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """By conversation (null is one) and chunk."""
    met = a.alias("a").join(b.alias("b"), F.col("a.c").eqNullSafe(F.col("b.c")) & (F.col("a.chunk") == F.col("b.chunk")), how)
    return met.select("a.*", *[f"b.{c}" for c in b.columns if c not in ("c", "chunk")])


class Repair:
    """The repair of a table of conversations: its rows in order, their faults, and the edits by chunk."""

    def __init__(self, df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BITS):
        self.bits = bits
        space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
        rows = df.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").cast("bigint").alias("t"), space(role).alias("role"), space(text).alias("text"))
        # equal rows are told apart, so that a row that is repeated very often can be split too
        rows = rows.withColumns({"h": F.unhex(F.sha2("text", 256)), "salt": F.monotonically_increasing_id()})
        order = [F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), "role", "h", "salt"]
        ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        self.rows = stored(ordered.select("c", "t", "role", "text", "h", F.monotonically_increasing_id().alias("pos")), "conversation-rows")
        self.faults = cut(self._faults())
        self.codes, self.borders = self._search()

    def _faults(self) -> DataFrame:
        trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
        same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.hex("h")), 256))
        kind = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
        light = self.rows.select("c", "t", "pos", kind.alias("kind"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("open"), same.alias("same"))
        seen = light.groupBy("c", "same").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
        met = light.alias("a").join(seen.alias("b"), F.col("a.c").eqNullSafe(F.col("b.c")) & (F.col("a.same") == F.col("b.same")), "left")
        later = F.coalesce(F.col("a.pos") > F.col("b.first"), F.lit(False))
        return met.select("a.c", "a.t", "a.pos", "a.kind", "a.blank", (~F.col("a.blank") & later).alias("duplicate"), (~F.col("a.blank") & ~later & F.col("a.open")).alias("truncated"))

    def _search(self) -> tuple[DataFrame, DataFrame]:
        number = F.col("kind") + F.when(F.col("blank") | F.col("duplicate"), 8).when(F.col("truncated"), 4).otherwise(0)
        letter = F.substring(F.lit(LETTERS), number + 1, F.lit(1))
        chunks = self.faults.groupBy("c", F.shiftright("pos", self.bits).alias("chunk")).agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", letter.alias("x")))).alias("each"))
        chunks = cut(chunks.select("c", "chunk", "start", F.array_join("each.x", "").alias("letters")))
        ends = chunks.groupBy("c").agg(F.min("chunk").alias("one"), F.max("chunk").alias("end")).where("one < end")  # conversations of several chunks
        chunks = chunks.alias("a").join(ends.alias("b"), F.col("a.c").eqNullSafe(F.col("b.c")), "left").select("a.*", F.col("b.end").isNull().alias("alone"), F.coalesce(F.col("a.chunk") == F.col("b.end"), F.lit(True)).alias("last"))
        kind = chunks.schema["c"].dataType.simpleString()
        borders = cut(chunks.mapInArrow(_settled, f"c {kind}, chunk bigint, last boolean, heads array<int>, added array<bigint>, illegal bigint, first_kind int, last_kind int"))
        several = _meets(borders, chunks.where("not alone").select("c", "chunk"))
        vectors = cut(_stitched(several, "heads", True, 0, lambda heads, end: heads[end if len(heads) > 1 else 0]).withColumnRenamed("value", "end"))
        chunks = _meets(chunks, vectors, "left").withColumn("end", F.coalesce("end", F.lit(0)))
        exits = chunks.where("not alone").mapInArrow(_exits, f"c {kind}, chunk bigint, exits array<int>")
        entries = _stitched(exits, "exits", False, 0, lambda exits, entry: exits[entry]).withColumnRenamed("value", "entry")
        chunks = _meets(chunks, entries, "left").withColumn("entry", F.coalesce("entry", F.lit(0)))
        codes = cut(chunks.mapInArrow(_traced, f"c {kind}, chunk bigint, start bigint, codes string"))
        return codes, cut(_meets(borders, vectors, "left").withColumn("end", F.coalesce("end", F.lit(0))))

    def edits(self) -> DataFrame:
        """One row per original row, in order of ``pos``: conversation, turn, role, text, fault, edit (its letter), new_role, and inserted (roles of the rows put before it)."""
        parts = self.codes.select("start", F.posexplode(F.regexp_extract_all("codes", F.lit("[ua]*[KDUA]"), F.lit(0))).alias("k", "code")).select((F.col("start") + F.col("k")).alias("pos"), "code")
        own = F.right("code", F.lit(1))
        named = F.create_map(*[F.lit(x) for x in ("u", "user", "a", "assistant", "U", "user", "A", "assistant")])
        fault = F.when(F.col("blank"), "blank").when(F.col("duplicate"), "duplicate").when(F.col("truncated"), "truncated")
        met = self.rows.join(parts, "pos").join(self.faults.select("pos", fault.alias("fault")), "pos")
        return met.select(F.col("c").alias("conversation"), F.col("t").alias("turn"), "pos", "role", "text", "fault", F.translate(own, "UA", "RR").alias("edit"), F.when(own == "K", F.col("role")).otherwise(named[own]).alias("new_role"), F.transform(F.split(F.regexp_replace("code", "[KDUA]", ""), "").cast("array<string>"), lambda x: named[x]).alias("put")).withColumn("inserted", F.filter("put", lambda x: x.isNotNull())).drop("put")

    def summary(self) -> DataFrame:
        """One row per conversation that has rows: c, gaps, the faults' counts, illegal, cost, audit."""
        one = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
        span = F.max("t") - F.min("t") + 1 - F.count_distinct("t")
        counts = self.faults.groupBy("c").agg(F.coalesce(span, F.lit(0)).cast("bigint").alias("gaps"), one("blank"), one("duplicate"), one("truncated"))
        value = lambda own: F.when(F.size(own) > 1, F.element_at(own, F.col("end") + 1)).otherwise(F.element_at(own, 1))
        costs = F.array(*[F.lit(v[0]).cast("bigint") for v in VECTORS])
        parts = _meets(self.borders, self.codes.select("c", "chunk", "codes")).select("c", "illegal", value("added").alias("added"), F.struct("chunk", "first_kind", "last_kind", F.translate("codes", "uaUA", "IIRR").alias("audit"), F.element_at(costs, value("heads") + 1).alias("head")).alias("p"))
        parts = parts.groupBy("c").agg(F.sum("added").alias("added"), F.sum("illegal").alias("illegal"), F.array_sort(F.collect_list("p")).alias("p"))
        seam = F.aggregate(
            F.sequence(F.lit(1), F.size("p")),
            F.lit(0).cast("bigint"),
            lambda n, k: n + F.when(k < F.size("p"), (~F.concat(F.element_at("p", k)["last_kind"].cast("string"), F.get("p", k)["first_kind"].cast("string")).isin("01", "12", "21")).cast("bigint")).otherwise(0),
        )
        parts = parts.select("c", (F.col("illegal") + seam).alias("illegal"), (F.col("added") + F.element_at("p", 1)["head"]).alias("cost"), F.array_join("p.audit", "").alias("audit"))
        met = counts.alias("a").join(parts.alias("b"), F.col("a.c").eqNullSafe(F.col("b.c")))
        return met.select("a.*", "b.illegal", "b.cost", "b.audit")

    def digests(self) -> DataFrame:
        """c and repaired_sha256, of each conversation's repaired ``role:text`` lines.

        The digest is sequential, so a conversation's rows pass through one task, sorted and one by one; none are held.
        """
        kind = self.rows.schema["c"].dataType.simpleString()
        codes = self.codes.select("c", "chunk", F.lit(-1).cast("bigint").alias("pos"), F.col("codes").alias("role"), F.lit(None).cast("string").alias("text"))
        rows = self.rows.select("c", F.shiftright("pos", self.bits).alias("chunk"), "pos", "role", "text")
        return codes.unionByName(rows).repartition("c").sortWithinPartitions("c", "chunk", "pos").mapInArrow(_digests, f"c {kind}, repaired_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, key, codes, at, lines = None, None, "", 0, 0
    names = {"u": "user:", "a": "assistant:", "U": "user:", "A": "assistant:"}

    def put(line: str) -> None:
        nonlocal lines
        digest.update((f"\n{line}" if lines else line).encode())
        lines += 1

    def rest() -> None:
        """Rows inserted after the last one."""
        for x in codes[at:]:
            put(names[x])

    for b in batches:
        done, kind = [], b.schema.field("c").type
        for c, pos, role, text in zip(*[b.column(x).to_pylist() for x in ("c", "pos", "role", "text")], strict=True):
            if pos < 0:
                if digest is None or c != key:
                    if digest is not None:
                        rest()
                        done.append((key, digest.hexdigest()))
                    digest, key, lines = hashlib.sha256(), c, 0
                codes, at = role, 0
                continue
            while codes[at] in "ua":
                put(names[codes[at]])
                at += 1
            if codes[at] != "D":
                put((f"{role}:" if codes[at] == "K" else names[codes[at]]) + text)
            at += 1
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([d for _, d in done])], ["c", "repaired_sha256"])
    if digest is not None:
        rest()
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()])], ["c", "repaired_sha256"])


def damaged(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role and text after the damage that the row's place says: a row is dropped, emptied, loses its stops, is repeated, or its role is set to user; nulls of role and text are one space before."""
    as_text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text(conv), F.lit(":"), as_text(turn)).cast("binary")) % 20
    rows = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), as_text(role).alias("role"), as_text(text).alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumns({"text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    times: Column = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", "role", "text", F.explode(times).alias("copy")).drop("copy")


def structure(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bits: int = BITS) -> DataFrame:
    """Every original conv_id with what its damaged rows need: the columns of :meth:`Repair.summary` and ``repaired_sha256``."""
    repair = Repair(damaged(df, conv, turn, role, text), bits=bits)
    every = df.select(F.col(f"`{conv}`").alias("conv_id")).distinct()
    met = every.alias("o").join(repair.summary().alias("s"), F.col("o.conv_id").eqNullSafe(F.col("s.c")), "left").join(repair.digests().alias("d"), F.col("o.conv_id").eqNullSafe(F.col("d.c")), "left")
    zero = lambda c: F.coalesce(f"s.{c}", F.lit(0).cast("bigint")).alias(c)
    return met.select("o.conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
