"""Conversation structure repair over a grammar that all conversations share.

A conversation is a row of symbols: the first letter of each role, and what is wrong with the turn. Re-Pair replaces the
pairs of symbols that the corpus has most often by rules. The cheapest edits of a row of symbols are a min-plus product of
one matrix per symbol, from state to state of the grammar of roles; the matrix of a rule is the product of its two parts,
worked out once, bottom-up, and every conversation that contains the rule uses it. An entry's audit is a rope of the two
entries it came from.

Rows of a conversation go by turn, nulls first, then by role and by the SHA-256 of the text; equal rows stand together.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from shelltrail.llm.common import leaves_no_tables, written

#: Most symbols of a conversation in one row; a longer conversation has several.
CHUNK = 1024
#: Bounds of the grammar. What they leave out is multiplied symbol by symbol: results do not depend on them.
MOST_RULES, MOST_ROUNDS, RULES_A_ROUND = 96, 8, 12
#: Rows of symbols whose product a worker remembers, and the longest of them: some 50 MB at most.
MOST_PRODUCTS, LONGEST_PRODUCT = 10_000, 32
#: Rows and characters of text after which a record batch goes out.
ROWS_OUT, CHARS_OUT = 10_000, 1 << 22

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"

#: States: nothing yet, after system, after user, after assistant; and where a turn of user or assistant leads.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {BEGIN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {"s": {BEGIN: SYSTEM}, "u": {BEGIN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Costs of the edits, and what a truncated turn that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What it takes to end a conversation in a state.
CLOSING = {BEGIN: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
LEGAL = {"su", "ua", "au"}

#: Symbols: a role's first letter (o: any other) for a sound turn, its capital for a truncated one, x for one that has to go.
TERMINALS = "suaoSUAOx"
FIRST_RULE = 0x100


def letters(rope):
    """The leaves of a rope, in order. A rope is a text or a pair of ropes."""
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top[1], top[0])


def less(one, other) -> bool:
    """Whether a rope's text comes before another's."""
    if isinstance(one, str) and isinstance(other, str):
        return one < other
    a, b = (itertools.chain.from_iterable(letters(rope)) for rope in (one, other))
    for x, y in itertools.zip_longest(a, b, fillvalue=""):
        if x != y:
            return x < y
    return False


def better(one: tuple | None, other: tuple | None) -> tuple | None:
    """The cheaper of two entries (cost, rope); of equals the one whose text comes first."""
    if one is None or other is None:
        return one or other
    if one[0] != other[0]:
        return one if one[0] < other[0] else other
    return one if less(one[1], other[1]) else other


def symbol_matrix(symbol: str) -> list[list[tuple | None]]:
    """For each state before and after: the cheapest insertions in front of a turn and edit of it.

    Insertions come in front of an edit only, so a text of edits ends with a turn's own edit. Two texts for the same turns
    therefore are never one the beginning of the other, and the least of a product is the product of the least.
    """
    found: list[list[tuple | None]] = [[None] * 4 for _ in range(4)]
    letter, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for begin in range(4):
        state, cost, audit = begin, 0, ""
        for _ in range(3):
            ways = [(state, cost + DELETE, "D")]
            if letter != "x":
                ways.append((NEXT[state], cost + REROLE + more, "R"))
                if state in KEEPS.get(letter, ()):
                    ways.append((KEEPS[letter][state], cost + more, "K"))
            for to, total, edit in ways:
                found[begin][to] = better(found[begin][to], (total, audit + edit))
            state, cost, audit = NEXT[state], cost + INSERT, audit + "I"
    return found


def product(one: list, other: list) -> list[list[tuple | None]]:
    """Min-plus: from state to state through any state between."""
    found: list[list[tuple | None]] = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for k in range(4):
            if one[i][k] is None:
                continue
            for j in range(4):
                if other[k][j] is not None:
                    found[i][j] = better(found[i][j], (one[i][k][0] + other[k][j][0], (one[i][k][1], other[k][j][1])))
    return found


class Grammar:
    """Rules in the order of their making, and the matrix of every symbol."""

    def __init__(self, rules: list[str]):
        self.rules = rules
        self.matrices = {symbol: symbol_matrix(symbol) for symbol in TERMINALS}
        for n, (left, right) in enumerate(rules):
            self.matrices[chr(FIRST_RULE + n)] = product(self.matrices[left], self.matrices[right])
        self.products: dict[str, list] = {}

    def compressed(self, symbols: str) -> str:
        for n, pair in enumerate(self.rules):
            symbols = symbols.replace(pair, chr(FIRST_RULE + n))
        return symbols

    def matrix(self, symbols: str) -> list:
        """The product over a row of symbols, its ropes as texts; that of a short row is remembered."""
        found = self.products.get(symbols)
        if found is None:
            whole = None
            for symbol in self.compressed(symbols):
                whole = self.matrices[symbol] if whole is None else product(whole, self.matrices[symbol])
            found = [[entry and (entry[0], "".join(letters(entry[1]))) for entry in row] for row in whole]
            if len(symbols) <= LONGEST_PRODUCT:
                if len(self.products) >= MOST_PRODUCTS:
                    self.products.clear()
                self.products[symbols] = found
        return found

    def repair(self, chunks: list[str]) -> tuple[int, str]:
        """(cost, audit) of a conversation given as rows of symbols: costs to the end first, then the walk from the start.

        Of equal ways on, the one whose text for this row of symbols comes first is right, as no such text begins another.
        Only costs are kept of all rows; audits are worked out again on the walk.
        """
        to_end = [{state: cost for state, (cost, _) in CLOSING.items()}]
        for symbols in reversed(chunks):
            matrix, after = self.matrix(symbols), to_end[-1]
            to_end.append({i: min(matrix[i][j][0] + after[j] for j in range(4) if matrix[i][j]) for i in range(4)})
        to_end.reverse()
        state, audit = BEGIN, []
        for symbols, here, after in zip(chunks, to_end, to_end[1:]):
            ways = [(entry[1], j) for j, entry in enumerate(self.matrix(symbols)[state]) if entry and entry[0] + after[j] == here[state]]
            text, state = min(ways)
            audit.append(text)
        return to_end[0][BEGIN], "".join(audit) + CLOSING[state][1]


def count_pairs(symbols: str) -> Counter:
    """Pairs of neighbours, in runs of one symbol those that do not overlap."""
    found: Counter = Counter()
    for symbol, run in itertools.groupby(symbols):
        n = sum(1 for _ in run)
        if n > 1:
            found[symbol + symbol] += n // 2
    found.update(a + b for a, b in zip(symbols, symbols[1:]) if a != b)
    return found


def disjoint(pairs: list[str], most: int) -> list[str]:
    """Of pairs in order those without a symbol of an earlier one: replacing one does not change how often others occur."""
    found, used = [], set()
    for pair in pairs:
        if len(found) < most and not used & set(pair):
            found.append(pair)
            used |= set(pair)
    return found


def shared_grammar(chunks: DataFrame, most_rules: int = MOST_RULES, most_rounds: int = MOST_ROUNDS) -> list[str]:
    """Re-Pair rules over all rows of `symbols`: each round counts all pairs, weighted by how often a row occurs, and makes
    rules of the most frequent ones that share no symbol. The driver sees at most one number per pair of symbols."""
    distinct = written(chunks.groupBy("symbols").agg(F.count("*").alias("n")), "repair-symbols")
    rules: list[str] = []
    for _ in range(most_rounds):
        so_far = list(rules)

        def count(batches):
            grammar, found = Grammar(so_far), Counter()
            for batch in batches:
                for symbols, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                    for pair, times in count_pairs(grammar.compressed(symbols)).items():
                        found[pair] += times * n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        counted = distinct.mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1")
        pairs = [row.pair for row in counted.orderBy(F.desc("n"), "pair").limit(4 * RULES_A_ROUND).collect()]
        rules += disjoint(pairs, min(RULES_A_ROUND, most_rules - len(rules)))
        if len(rules) == len(so_far) or len(rules) >= most_rules:
            break
    return rules


def _same(columns: list[str], others: list[str]) -> Column:
    found = F.lit(True)
    for one, other in zip(columns, others):
        found = found & F.col(one).eqNullSafe(F.col(other))
    return found


def turns_of(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: Column | None = None) -> DataFrame:
    """conv_id (a number or a text), turn, role, text, copies, hash: nulls of role and text are one space."""
    number = isinstance(turns.schema[conv_id].dataType, IntegralType)
    whole = turns.select(
        F.col(conv_id).cast("long" if number else "string").alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("long").alias("copies"),
    )
    return whole.withColumn("hash", F.unhex(F.sha2("text", 256)))


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, hash, n, fault: a row per distinct turn of a conversation, `n` times there.

    The first fault counts: `b`lank, `d`uplicate (role and text are those of a turn before), `t`runcated, else ''. Of `n` equal
    turns all but the first are duplicates whatever `fault` says, unless they are blank. Equal turns are counted on the map
    side and the earliest turn of a text is an aggregate, so no conversation and no text gathers in one task.
    """
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    own = F.when(F.length(said) == 0, "b").when(~F.right(said, F.lit(1)).isin(*ENDS), "t").otherwise("")
    key = ["conv_id", "turn", "role", "hash"]
    distinct = turns.select(*key, "copies", own.alias("fault")).groupBy(*key).agg(F.sum("copies").alias("n"), F.max("fault").alias("fault"))
    place = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn"))
    first = distinct.groupBy("conv_id", "role", "hash").agg(F.min(place).alias("first"))
    first = first.select(F.col("conv_id").alias("f_conv_id"), F.col("first.turn").alias("f_turn"), F.col("role").alias("f_role"), F.col("hash").alias("f_hash"))
    found = distinct.join(first, _same(key, ["f_" + name for name in key]), "left")
    fault = F.when((F.col("fault") != "b") & F.col("f_hash").isNull(), "d").otherwise(F.col("fault"))
    return found.select(*key, "n", fault.alias("fault"))


COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]
CHUNK_NAMES = ["conv_id", "place", "symbols", *COUNTS, "first", "last", "least", "most", "ends_at"]


def symbol_chunks(found: DataFrame) -> DataFrame:
    """Rows of up to CHUNK symbols of one conversation, numbered in order by `place`, with what is counted in them.

    One sort by ranges of (conv_id, turn, role, hash): a conversation with a large part of all rows spans several tasks.
    `turns` counts distinct turn numbers that the row begins, `least` and `most` are its turn numbers, `first` and `last` its
    first and last role letters, `ends_at` the turn number it ends with.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    narrow = found.select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "fault", "role", "hash")
    kind = found.schema["conv_id"].dataType.simpleString()

    def build(batches):
        from pyspark import TaskContext

        places = itertools.count(TaskContext.get().partitionId() << 40)
        open_, done = None, []

        def close():
            done.append((open_["conv_id"], next(places), "".join(open_["symbols"]), *(open_[c] for c in COUNTS), *(open_[c] for c in CHUNK_NAMES[8:])))

        for batch in batches:
            for conv_id, turn, initial, n, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "n", "fault"))):
                letter = initial if initial in KEEPS else "o"
                while n > 0:
                    if open_ is None or open_["conv_id"] != conv_id or len(open_["symbols"]) >= CHUNK:
                        before = open_["ends_at"] if open_ is not None and open_["conv_id"] == conv_id else None
                        if open_ is not None:
                            close()
                        open_ = dict.fromkeys(COUNTS, 0) | {"conv_id": conv_id, "symbols": [], "first": initial, "last": None, "least": turn, "most": turn, "ends_at": before}
                    # Of equal turns the first is judged by itself; the others follow in one go.
                    alone = fault in ("", "t")
                    some = min(n, 1 if alone else CHUNK - len(open_["symbols"]))
                    symbol = "x" if fault in ("b", "d") else letter.upper() if fault == "t" else letter
                    open_["symbols"] += [symbol] * some
                    for counted, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated")):
                        open_[name] += some if fault == counted else 0
                    open_["illegal"] += some - 1
                    if open_["last"] is not None:
                        open_["illegal"] += open_["last"] + initial not in LEGAL
                    if turn is not None:
                        open_["turns"] += turn != open_["ends_at"]
                        open_["least"], open_["most"] = turn if open_["least"] is None else open_["least"], turn
                    open_["last"], open_["ends_at"] = initial, turn
                    n -= some
                    if alone:
                        fault = "d"
                if len(done) >= ROWS_OUT:
                    yield rows_out(done)
                    done.clear()
        if open_ is not None:
            close()
        if done:
            yield rows_out(done)

    number, text = pa.int64(), pa.string()
    types = [text if kind == "string" else number, number, text, *[number] * len(COUNTS), text, text, number, number, number]

    def rows_out(done):
        return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*done), types)], names=CHUNK_NAMES)

    counts = ", ".join(f"{c} long" for c in COUNTS)
    schema = f"conv_id {kind}, place long, symbols string, {counts}, first string, last string, least long, most long, ends_at long"
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("conv_id", "turn", "initial", "n", "fault").mapInArrow(build, schema)


SOLVED_NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def solved(chunks: DataFrame, rules: list[str]) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: a row per conversation, whose rows of symbols pass
    through one task in order; it holds one conversation's symbols, which are as long as its audit."""
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def solve(batches):
        grammar, rows, held = Grammar(rules), [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in CHUNK_NAMES)):
                if held and held[0][0] != row[0]:
                    rows.append(conversation(held, grammar))
                    held = []
                held.append(row)
            if len(rows) >= ROWS_OUT:
                yield rows_out(rows)
                rows = []
        if held:
            rows.append(conversation(held, grammar))
        if rows:
            yield rows_out(rows)

    def conversation(held, grammar):
        at = {name: n for n, name in enumerate(CHUNK_NAMES)}
        total = {c: sum(row[at[c]] for row in held) for c in COUNTS}
        for one, other in zip(held, held[1:]):
            total["illegal"] += one[at["last"]] + other[at["first"]] not in LEGAL
            # A row that begins a new task does not know which turn the one before it ended with.
            same = other[at["least"]] is not None and one[at["most"]] == other[at["least"]]
            total["turns"] -= same and other[at["place"]] >> 40 != one[at["place"]] >> 40
        least = [row[at["least"]] for row in held if row[at["least"]] is not None]
        most = [row[at["most"]] for row in held if row[at["most"]] is not None]
        gaps = max(most) - min(least) + 1 - total["turns"] if least else 0
        cost, audit = grammar.repair([row[at["symbols"]] for row in held])
        return held[0][0], gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost, audit

    types = [pa.string() if kind == "string" else pa.int64(), *[pa.int64()] * 6, pa.string()]

    def rows_out(rows):
        return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names=SOLVED_NAMES)

    counts = ", ".join(f"{c} long" for c in SOLVED_NAMES[1:-1])
    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(solve, f"conv_id {kind}, {counts}, audit string")


def repaired_turns(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the turns as repaired, in order within a task. Turns stream past their audit."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    wide = turns.select("conv_id", "turn", "role", "hash", "text", "copies", F.lit(None).cast("string").alias("audit"))
    first = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast(t).alias(c) for c, t in (("role", "string"), ("hash", "binary"), ("text", "string"), ("copies", "long"))), "audit")
    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "hash"]
    ordered = wide.union(first).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "audit", "role", "text", "copies")
    types = [pa.string() if kind == "string" else pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def repair(batches):
        rows, conv_id, audit, at, state, place, size = [], None, "", 0, BEGIN, 0, 0

        def insert():
            nonlocal at, state, place
            while audit[at : at + 1] == "I":
                state = NEXT[state]
                rows.append((conv_id, place, "I", ROLE[state], ""))
                at, place = at + 1, place + 1

        for batch in batches:
            for this, begins, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies"))):
                if begins is not None:
                    insert()
                    conv_id, audit, at, state, place = this, begins, 0, BEGIN, 0
                    continue
                for _ in range(copies):
                    insert()
                    edit, at = audit[at], at + 1
                    if edit == "D":
                        continue
                    state = NEXT[state] if edit == "R" else KEEPS[role[:1]][state]
                    rows.append((conv_id, place, edit, ROLE[state] if edit == "R" else role, text))
                    place, size = place + 1, size + len(text)
                    if len(rows) >= ROWS_OUT or size >= CHARS_OUT:
                        yield rows_out(rows)
                        rows, size = [], 0
        insert()
        if rows:
            yield rows_out(rows)

    def rows_out(rows):
        return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names=["conv_id", "place", "edit", "role", "text"])

    return ordered.mapInArrow(repair, f"conv_id {kind}, place long, edit string, role string, text string")


def text_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of `role:text` of the turns, joined by line feeds. Reads rows in the order they come in."""
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def digest(batches):
        rows, last, running = [], None, None
        for batch in batches:
            for conv_id, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if running is not None:
                        rows.append((last, running.hexdigest()))
                    last, running = conv_id, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    running.update(f"\n{role}:{text}".encode())
            if rows:
                yield rows_out(rows)
                rows = []
        if running is not None:
            yield rows_out([*rows, (last, running.hexdigest())])

    def rows_out(rows):
        return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names=["conv_id", "repaired_sha256"])

    types = [pa.string() if kind == "string" else pa.int64(), pa.string()]
    return repaired.select("conv_id", "place", "role", "text").mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def audits(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns` (see `turns_of`): gaps in its turn numbers, its faults, and its cheapest repair.

    `audit` has the first letters of the edits in order: Keep, Rerole, Delete, Insert. Blank and duplicate turns are deleted.
    The roles left begin `(s?(ua)+)?`. Of equally cheap repairs the one whose audit comes first in ASCII counts.
    Null ids are one conversation, null turn numbers come first and have no gap, empty roles and roles that begin with another
    letter can only be reroled or deleted, repeated rows are duplicates. No rows give no row.
    Ids are numbers or texts. One conversation's audit has to fit into a row, its texts need not.
    """
    chunks = written(symbol_chunks(faults(turns)), "repair-chunks")
    return written(solved(chunks, shared_grammar(chunks)), "repair-audits")


@leaves_no_tables
def repair_digest(turns: DataFrame, everyone: DataFrame) -> DataFrame:
    """The audits of `turns`, with the digest of the repaired texts, for every conv_id of `everyone`: without any turns
    zeros, no audit, and the digest of nothing."""
    found = audits(turns)
    digests = text_digests(repaired_turns(turns, found)).withColumnRenamed("conv_id", "d_conv_id")
    ids = everyone.select("conv_id").distinct()
    found = found.withColumnRenamed("conv_id", "a_conv_id")
    out = ids.join(found, _same(["conv_id"], ["a_conv_id"]), "left").join(digests, _same(["conv_id"], ["d_conv_id"]), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SOLVED_NAMES[1:-1]]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns as `turns_of` gives them, damaged by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text,
    2 takes `.!?` out of it, 3 repeats it, 4 makes its role user. Nulls are one space, in the crc32's text too."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    turns = turns.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("way"))
    way, text = F.col("way"), F.coalesce("text", F.lit(" "))
    hurt = turns.filter(way != 0).select(
        "conv_id",
        "turn",
        F.when(way == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(way == 1, "").when(way == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.when(way == 3, 2).otherwise(1).alias("copies"),
    )
    return turns_of(hurt, copies=F.col("copies"))
