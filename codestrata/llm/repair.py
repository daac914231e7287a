"""Repair of conversation structure: sorted turns stream through a task that carries the state of a cheapest-edit search.

Legal role initials are ``(s?(ua)+)?``. After any prefix of them there are four states: nothing yet, after s,
after u, after a; each but the first leaves one role that may come next. The search keeps for every state the
least cost and, among equal costs, the place of its edit letters in ASCII order. Costs relative to the least
and places take few values, so a step is one lookup in a table, and what a row leaves behind is a 16-bit
number that names the predecessors of all states. Where all states go back to one, earlier rows are decided
and given out; what is not yet decided goes to a file when it gets too large.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

#: Costs of edits, and what a truncated row adds if it stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: START (nothing yet), after s, after u, after a; what may come next, and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that bring a state to a legal end.
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: From every state, two inserts and a deletion reach what any other offers: dearer ones are never needed.
NEVER = 2 * INSERT + DELETE
#: Undecided rows are kept in chunks of so many rows or bytes; beyond ``HELD`` bytes the oldest go to a file.
CHUNK_ROWS, CHUNK_BYTES, HELD = 256, 1 << 20, 1 << 26
#: Rows of a batch of answers.
ROWS = 4096

#: A row of the sorted stream: a mark that role and text stand in several rows (here first, or earlier), or a turn.
FIRST, AGAIN, TURN = range(3)
FAULTS = PLAIN, BLANK, CUT, TWICE = range(4)
NAMES = ["", "blank", "truncated", "duplicate"]
BLANKS = " \t\n\x0b\x0c\r"


class Steps:
    """The table of steps, filled as they are met; ``pointers[i][state]`` is (state before, edit letters)."""

    def __init__(self) -> None:
        self.pointers: list[dict[int, tuple[int, str]]] = []
        self._known: dict[tuple, tuple] = {}

    def step(self, at: tuple, initial: str, fault: int) -> tuple:
        """(states after a row, cost that all of them have in common, number of the pointers).

        ``at`` holds (state, cost above the least, place in ASCII order) of every state that can still win.
        """
        key = (at, initial if initial in ("s", "u", "a") else "", fault)
        if key not in self._known:
            self._known[key] = self._new(at, initial, fault)
        return self._known[key]

    def _new(self, at: tuple, initial: str, fault: int) -> tuple:
        best: dict[int, tuple] = {}

        def offer(state: int, cost: int, place: int, letters: str, before: int) -> None:
            new = (cost, place, letters, before)
            if state not in best or new < best[state]:
                best[state] = new

        for before, cost, place in at:
            state, letters = before, ""
            for _ in range(3):  # no insert, one, two: a third only repeats a state
                offer(state, cost + DELETE, place, letters + "D", before)
                if fault not in (BLANK, TWICE):
                    stays = cost + (TRUNCATED if fault == CUT else 0)
                    if (state, initial) in LEGAL:
                        offer(LEGAL[state, initial], stays, place, letters + "K", before)
                    offer(AFTER[state], stays + REROLE, place, letters + "R", before)
                state, cost, letters = AFTER[state], cost + INSERT, letters + "I"
        least = min(b[0] for b in best.values())
        best = {s: b for s, b in best.items() if b[0] <= least + NEVER}
        order = {s: i for i, s in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        self.pointers.append({s: (b[3], b[2]) for s, b in best.items()})
        return tuple((s, b[0] - least, order[s]) for s, b in sorted(best.items())), least, len(self.pointers) - 1


class Chunk:
    """Pointers and (role, text) of some undecided rows, in memory or in a file."""

    def __init__(self) -> None:
        self.pointers, self.rows, self.bytes = array("H"), [], 0
        self._at: tuple[int, int, int] | None = None

    def full(self) -> bool:
        return len(self.rows) >= CHUNK_ROWS or self.bytes >= CHUNK_BYTES

    def spill(self, file) -> None:
        at = file.seek(0, 2)
        file.write(self.pointers.tobytes())
        self._at = (at, len(self.pointers) * self.pointers.itemsize, file.write(pickle.dumps(self.rows)))
        self.pointers, self.rows = None, None

    def read_pointers(self, file) -> array:
        if self._at is None:
            return self.pointers
        file.seek(self._at[0])
        out = array("H")
        out.frombytes(file.read(self._at[1]))
        return out

    def read_rows(self, file) -> list[tuple[str, str]]:
        if self._at is None:
            return self.rows
        file.seek(self._at[0] + self._at[1])
        return pickle.loads(file.read(self._at[2]))


class Conversation:
    """The search over one conversation; ``give`` takes its edits in order as soon as they are decided."""

    def __init__(self, steps: Steps, give) -> None:
        self.steps, self.give = steps, give
        self.at, self.base = ((START, 0, 0),), START
        self.chunks: list[Chunk] = []
        self.held, self.file, self.spilled, self.look = 0, None, 0, 2

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if not self.chunks or self.chunks[-1].full():
            self._close()
            self.chunks.append(Chunk())
        self.at, _, pointer = self.steps.step(self.at, role[:1], fault)
        c = self.chunks[-1]
        c.pointers.append(pointer)
        c.rows.append((turn, role, text, fault))
        c.bytes += 4 * (len(role) + len(text)) + 64

    def finish(self) -> None:
        _, _, state = min((c + INSERT * TO_END[s], place, s) for s, c, place in self.at)
        self._decide(len(self.chunks), state)
        for _ in range(TO_END[state]):
            self.base = AFTER[self.base]
            self.give("I", None, None, ROLE[self.base], "", PLAIN)

    def _close(self) -> None:
        """The newest chunk is full: decide what can be decided, from time to time; keep memory bounded."""
        self.held += self.chunks[-1].bytes if self.chunks else 0
        if len(self.chunks) >= self.look:
            states = {s for s, _, _ in self.at}
            for i in range(len(self.chunks), 0, -1):
                if len(states) == 1:  # all that can still win agrees up to here
                    self._decide(i, states.pop())
                    break
                states = self._back(self.chunks[i - 1], states)
            self.look = 2 * len(self.chunks) + 2
        while self.held > HELD and self.spilled < len(self.chunks):
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # has no name, goes with the task
            c = self.chunks[self.spilled]
            c.spill(self.file)
            self.held -= c.bytes
            self.spilled += 1

    def _back(self, chunk: Chunk, states: set[int]) -> set[int]:
        for p in reversed(chunk.read_pointers(self.file)):
            states = {self.steps.pointers[p][s][0] for s in states}
        return states

    def _decide(self, n: int, state: int) -> None:
        """The search is in ``state`` at the end of the first ``n`` chunks: give their edits, forget them."""
        ends = [state]
        for c in reversed(self.chunks[:n]):
            ends.append(self._back(c, {ends[-1]}).pop())
        ends.reverse()  # ends[i] is the state before chunk i
        for i, c in enumerate(self.chunks[:n]):
            edits, s = [], ends[i + 1]
            for p in reversed(c.read_pointers(self.file)):
                s, letters = self.steps.pointers[p][s]
                edits.append(letters)
            for letters, row in zip(reversed(edits), c.read_rows(self.file)):
                self._apply(letters, *row)
            if i >= self.spilled:
                self.held -= c.bytes
        del self.chunks[:n]
        self.spilled = max(0, self.spilled - n)
        if self.file is not None and not self.spilled:
            self.file.seek(0)
            self.file.truncate()

    def _apply(self, letters: str, turn: int | None, role: str, text: str, fault: int) -> None:
        for x in letters:
            if x == "I":
                self.base = AFTER[self.base]
                self.give("I", None, None, ROLE[self.base], "", PLAIN)
            elif x == "D":
                self.give("D", turn, role, None, text, fault)
            elif x == "K":
                self.base = LEGAL[self.base, role[:1]]
                self.give("K", turn, role, role, text, fault)
            else:
                self.base = AFTER[self.base]
                self.give("R", turn, role, ROLE[self.base], text, fault)


_EDITS = ["conv_id", "step", "edit", "turn", "old_role", "role", "text", "fault"]
_EDIT_TYPES = "conv_id bigint, step bigint, edit string, turn bigint, old_role string, role string, text string, fault string"


def _edits(frames: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """Lists of edits (columns ``_EDITS``, fault as a number) of the sorted stream; state goes on from frame to frame."""
    steps = Steps()
    ready: list[tuple] = []
    now, some, talk, step = None, False, None, 0
    marks: tuple = (None, None, None)  # turn, digest, and whether the next such row is the first of its text
    seen = False

    def give(edit, turn, old, role, text, fault) -> None:
        nonlocal step
        ready.append((now, step, edit, turn, old, role, text, fault))
        step += 1

    for f in frames:
        for conv, turn, role, text, digest, what, fault in zip(*[f[c].array for c in ("conv_id", "turn", "role", "text", "digest", "what", "fault")]):
            conv, turn = (None if pd.isna(conv) else int(conv)), (None if pd.isna(turn) else int(turn))
            if not some or conv != now:
                if some:
                    talk.finish()
                now, some, step, marks = conv, True, 0, (None, None, None)
                talk = Conversation(steps, give)
            if what != TURN:
                marks, seen = (turn, digest, what), what == AGAIN
                continue
            if fault != BLANK and marks[1] == digest and marks[0] == turn:
                fault, seen = (TWICE if seen else fault), True
            talk.add(turn, role, text, int(fault))
            if len(ready) >= ROWS:
                yield ready
                ready.clear()
    if some:
        talk.finish()
    if ready:
        yield ready


def _repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _edits(frames):
        f = pd.DataFrame(rows, columns=_EDITS)
        f["turn"] = f["turn"].astype("Int64")
        f["conv_id"] = f["conv_id"].astype("Int64")
        f["fault"] = [NAMES[x] for x in f["fault"]]
        yield f


def _reported(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the edits of every conversation add up to; digests are fed row by row."""
    out: list[tuple] = []
    now, some = None, False
    faults = cost = illegal = kept = turns = n = 0
    first = last = before = digest = None
    audit: list[str] = []

    def done() -> tuple:
        gaps = last - first + 1 - turns if turns else 0
        return now, gaps, faults[BLANK], faults[TWICE], faults[CUT], illegal, cost, "".join(audit), digest.hexdigest(), n, kept

    for rows in _edits(frames):
        for conv, _, edit, turn, old, role, text, fault in rows:
            if not some or conv != now:
                if some:
                    out.append(done())
                now, some, faults, cost, illegal, kept, turns, n = conv, True, [0] * 4, 0, 0, 0, 0, 0
                first = last = before = None
                digest, audit = hashlib.sha256(), []
            audit.append(edit)
            cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == CUT and edit != "D" else 0)
            if edit != "I":
                n += 1
                faults[fault] += 1
                illegal += before is not None and before + old[:1] not in ("su", "ua", "au")
                before = old[:1]
                if turn is not None and turn != last:
                    first, last, turns = (turn if first is None else first), turn, turns + 1
            if edit != "D":
                digest.update(f"\n{role}:{text}".encode() if kept else f"{role}:{text}".encode())
                kept += 1
        if len(out) >= ROWS:
            yield pd.DataFrame(out, columns=REPORT).astype({"conv_id": "Int64"})
            out = []
    if some:
        out.append(done())
    if out:
        yield pd.DataFrame(out, columns=REPORT).astype({"conv_id": "Int64"})


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256", "n_turns", "n_repaired"]
_REPORT_TYPES = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'bigint'}" for c in REPORT)


def _tail(text: Column) -> Column:
    """The last character of ``text`` that is no blank; empty where there is none."""
    return F.right(F.rtrim(text, F.lit(BLANKS)), F.lit(1))


def _sorted(turns: DataFrame) -> DataFrame:
    """Turns and, before them, marks of texts that stand in several rows, in conversation order within partitions.

    Marks are made from slim rows: which role and text come first is an aggregate over hashes, so no task has
    to remember what a conversation said, and texts are moved once.
    """
    d = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    last = _tail(F.col("text"))
    d = d.withColumn("fault", F.when(last == "", BLANK).when(last.isin(".", "!", "?"), PLAIN).otherwise(CUT))
    d = d.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text").cast("binary"))))
    slim = d.where(F.col("fault") != BLANK).select(F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("conv_id").isNull().alias("none"), "digest", "turn")
    key = ["c", "none", "digest"]
    order = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"))
    many = slim.groupBy(*key, "turn").agg(F.count("*").alias("n"))
    twice = many.groupBy(*key).agg(F.sum("n").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n")
    marks = many.drop("n").join(twice, key)
    marks = marks.select(F.when(~F.col("none"), F.col("c")).alias("conv_id"), "turn", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                         F.lit(PLAIN).alias("fault"), "digest", F.when(F.col("turn").eqNullSafe(F.col("first.turn")), FIRST).otherwise(AGAIN).alias("what"))
    every = d.withColumn("what", F.lit(TURN)).unionByName(marks)
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "digest", "what")


def repair(turns: DataFrame) -> DataFrame:
    """Every edit of every conversation: conv_id, step, edit (K, R, D or I), turn, old_role, role, text, fault.

    The repaired conversation is its rows with a role, by step; a row of edit D has none. Rows of a
    conversation are taken by turn (nulls first), then by a hash of role and text; null role and text count as
    empty; rows without conv_id form one conversation; equal rows are as many turns, all but the first of them
    duplicates; an empty table gives an empty result; other columns are not read. A conversation is one task's
    work, as its repaired rows have an order; memory is bounded by ``HELD`` and one text, as rows that are not
    yet decided, with their backpointers of two bytes, go to a file of the task.
    """
    return _sorted(turns).mapInPandas(_repaired, _EDIT_TYPES)


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation: what ``repair`` does with it, in counts, cost, audit letters and a digest.

    Cases as in ``repair``. The audit has a letter per edit, so it has to fit into one cell.
    """
    return _sorted(turns).mapInPandas(_reported, _REPORT_TYPES)


def damage(turns: DataFrame) -> DataFrame:
    """Rows hurt by crc32(``conv_id:turn``) % 20; nulls become one space; dropped rows are gone."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    d = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    d = d.where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = report(damage(turns)).withColumnRenamed("conv_id", "conv")
    every = turns.select("conv_id").distinct()
    d = every.join(told, every["conv_id"].eqNullSafe(told["conv"]), "left")
    zero = F.lit(0).cast("bigint")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return d.select("conv_id", *[F.coalesce(c, F.lit("") if c == "audit" else nothing if c == "repaired_sha256" else zero).alias(c) for c in REPORT[1:]])


OP11_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda c: list_transform(range(8), lambda j: (ascii(c)::BIGINT >> j) & 1)))),
            lambda crc, b: xor(crc >> 1, 3988292384 * (xor(crc, b) & 1))), 4294967295) % 20 AS kind FROM raw),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT c, turn, role, text, copy, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), copy) AS i,
         left(role, 1) AS ini, right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail
  FROM hurt JOIN convs ON hurt.conv_id IS NOT DISTINCT FROM convs.conv_id),
told AS (
  SELECT *, CASE WHEN tail = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN tail NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(ini) OVER (PARTITION BY c ORDER BY i) AS before, count(*) OVER (PARTITION BY c) AS n FROM placed),
ins(s, k, t, said) AS (VALUES
  (0, 0, 0, ''), (0, 1, 2, chr(10) || 'user:'), (0, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 0, 1, ''), (1, 1, 2, chr(10) || 'user:'), (1, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 0, 2, ''), (2, 1, 3, chr(10) || 'assistant:'), (2, 2, 2, chr(10) || 'assistant:' || chr(10) || 'user:'),
  (3, 0, 3, ''), (3, 1, 2, chr(10) || 'user:'), (3, 2, 3, chr(10) || 'user:' || chr(10) || 'assistant:')),
edits(t, ini, letter, nxt, paid, said) AS (VALUES
  (0, NULL, 'D', 0, 4, ''), (1, NULL, 'D', 1, 4, ''), (2, NULL, 'D', 2, 4, ''), (3, NULL, 'D', 3, 4, ''),
  (0, NULL, 'R', 2, 3, 'user'), (1, NULL, 'R', 2, 3, 'user'), (2, NULL, 'R', 3, 3, 'assistant'), (3, NULL, 'R', 2, 3, 'user'),
  (0, 's', 'K', 1, 0, ''), (0, 'u', 'K', 2, 0, ''), (1, 'u', 'K', 2, 0, ''), (2, 'a', 'K', 3, 0, ''), (3, 'u', 'K', 2, 0, '')),
moves AS (
  SELECT ins.s, edits.ini, letter, nxt, 3 * k + paid AS paid, repeat('I', k) || letter AS letters, ins.said AS first, edits.said AS as_role
  FROM ins JOIN edits ON ins.t = edits.t),
dp AS (
  SELECT c, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, '' AS said FROM convs
  UNION ALL
  SELECT c, i, nxt, cost, audit, said FROM (
    SELECT *, row_number() OVER (PARTITION BY c, nxt ORDER BY cost, audit) AS place FROM (
      SELECT dp.c, told.i, nxt, cost + paid + CASE WHEN fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END AS cost, audit || letters AS audit,
             said || first || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || as_role || ':' || text END AS said
      FROM dp JOIN told ON told.c = dp.c AND told.i = dp.i + 1 JOIN moves ON moves.s = dp.s
      WHERE (moves.ini IS NULL OR moves.ini = told.ini) AND (letter = 'D' OR fault NOT IN ('b', 'd')))) WHERE place = 1),
last AS (
  SELECT dp.c, cost + 3 * k AS cost, audit || repeat('I', k) AS audit, dp.said || ins.said AS said,
         row_number() OVER (PARTITION BY dp.c ORDER BY cost + 3 * k, audit || repeat('I', k)) AS place
  FROM dp JOIN ins ON dp.s = ins.s AND ins.k = CASE dp.s WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END
  WHERE dp.i = (SELECT count(*) FROM placed p WHERE p.c = dp.c)),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n_turns FROM told GROUP BY c)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(cost AS BIGINT) AS cost, audit, sha256(substr(said, 2)) AS repaired_sha256, coalesce(n_turns, 0) AS n_turns,
       CAST(length(replace(audit, 'D', '')) AS BIGINT) AS n_repaired
FROM last JOIN convs ON last.c = convs.c LEFT JOIN counts ON counts.c = last.c WHERE place = 1
"""
