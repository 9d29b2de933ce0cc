"""Cheapest repair of conversations by dynamic programming over a grammar.

A conversation is a string over nine symbols: who speaks (system, user, assistant, another) and whether the row has to go, is
cut short or is sound. Re-Pair replaces the pairs that are most frequent over all conversations by new symbols, round by
round. Every rule gets one min-plus transfer matrix over the states of ``(s?(ua)+)?``, from its two halves, with the audit as
a rope in each entry; it is evaluated once, bottom-up, and all conversations multiply their few symbols.

In a matrix insertions stand before the row they precede. Scripts of the same rows are then never beginnings of one another,
so the least of equal costs stays least whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markgrid.llm.common import add_columns, bounded, share, table
from markgrid.llm.turns import CRC_SQL, EMPTY, TURN_ORDER, numbered, tie_keys
from markgrid.session import cut

#: white space of the contracts, and what ends a sentence
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: symbols of rows: one that must go, then who speaks (system, user, assistant, another), sound and cut short
GONE, SOUND, SHORT = "x", "suao", "SUAO"
#: rounds of pair replacement, and rules a round makes at most; they set the cost, never the result
ROUNDS, RULES = 10, 24
#: first code point of rules, in a private area
RULE = 0xE000
#: states: nothing yet, after system, after user, after assistant
STATES = range(4)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: rows of a conversation whose symbols are gathered at once
RUN_ROWS = 1_024


@dataclass(frozen=True)
class Rope:
    """A string as the tree of its halves."""

    cost: int
    text: str = ""
    halves: tuple | None = None

    def flat(self) -> str:
        out, todo = [], [self]
        while todo:
            r = todo.pop()
            if r.halves:
                todo += [r.halves[1], r.halves[0]]
            else:
                out.append(r.text)
        return "".join(out)

    def __add__(self, other: Rope) -> Rope:
        return Rope(self.cost + other.cost, "", (self, other))


def better(a: Rope | None, b: Rope | None) -> Rope | None:
    """The cheaper of two scripts of the same rows, of equal costs the least in ASCII."""
    if a is None or b is None:
        return a or b
    if a.cost != b.cost:
        return a if a.cost < b.cost else b
    return a if a.flat() <= b.flat() else b


def insertions(i: int, j: int) -> Rope | None:
    """The cheapest insertions from state i to state j: user and assistant in turn, 2 each."""
    n, at = 0, i
    while at != j:
        at = 3 if at == 2 else 2
        n += 1
        if n > 2:
            return None
    return Rope(2 * n, "I" * n)


def symbol_matrix(symbol: str) -> list[list[Rope | None]]:
    """``[i][j]``: the cheapest way to take one row from state i to state j, insertions first."""
    short = int(symbol in SHORT)
    edits = [(i, i, Rope(3, "D")) for i in STATES]
    if symbol != GONE:
        edits += [(i, j, Rope(short, "K")) for i, j in NEXT.get(symbol.lower(), {}).items()]
        edits += [(i, j, Rope(2 + short, "R")) for to in "ua" for i, j in NEXT[to].items()]
    out: list[list[Rope | None]] = [[None] * 4 for _ in STATES]
    for i in STATES:
        for k, j, edit in edits:
            if (first := insertions(i, k)) is not None:
                out[i][j] = better(out[i][j], first + edit)
    return out


def times(a: list[list[Rope | None]], b: list[list[Rope | None]]) -> list[list[Rope | None]]:
    """Min-plus product with the least scripts."""
    out: list[list[Rope | None]] = [[None] * 4 for _ in STATES]
    for i in STATES:
        for k in STATES:
            if a[i][k] is not None:
                for j in STATES:
                    if b[k][j] is not None:
                        out[i][j] = better(out[i][j], a[i][k] + b[k][j])
    return out


def matrices(rules: list[tuple[str, str, str]]) -> dict[str, list[list[tuple[int, str] | None]]]:
    """Matrices of all symbols and of ``rules`` (symbol, left, right; halves before wholes), scripts written out."""
    known = {s: symbol_matrix(s) for s in GONE + SOUND + SHORT}
    for whole, left, right in rules:
        known[whole] = times(known[left], known[right])
    return {s: [[None if r is None else (r.cost, r.flat()) for r in row] for row in m] for s, m in known.items()}


def solved(shape: str, table_: dict) -> tuple[int, str]:
    """Cost and least audit of a conversation given as a string of symbols and rules.

    Of each state only the best script is kept, as a link to the state before; scripts of equal cost are told apart by the order
    of what they extend, then by their last part, so no script is written out on the way.
    """
    ways = {0: (0, 0)}  # state -> cost, order among the scripts
    links: list[dict[int, tuple[int, str]]] = []
    for symbol in shape:
        best: dict[int, tuple[int, int, str, int]] = {}
        for i, (cost, order) in ways.items():
            for j, entry in enumerate(table_[symbol][i]):
                if entry is not None:
                    new = (cost + entry[0], order, entry[1], i)
                    if j not in best or new < best[j]:
                        best[j] = new
        orders = {x: n for n, x in enumerate(sorted({(o, s) for _, o, s, _ in best.values()}))}
        links.append({j: (b[3], b[2]) for j, b in best.items()})
        ways = {j: (b[0], orders[b[1], b[2]]) for j, b in best.items()}
    ends = []
    for j, (cost, order) in ways.items():
        if j == 0:
            ends.append((cost, order, "", j))
        elif (close := insertions(j, 3)) is not None:
            ends.append((cost + close.cost, order, close.text, j))
    cost, _, last, j = min(ends)
    out = [last]
    for link in reversed(links):
        j, part = link[j]
        out.append(part)
    return cost, "".join(reversed(out))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after damage, one row each, with ``copy`` 0 or, of repeated rows, 1.

    Nulls of role and text are one space, as those of conv_id and turn are for the checksum that chooses the damage.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def symbols(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, _at, initial, fault, symbol`` of every row, ``_at`` being its place in the conversation from 0.

    Faults are blank, duplicate and truncated, the first that fits. Only slim rows are moved; equal rows of a conversation are
    counted before they meet.
    """
    end = F.rtrim("text", F.lit(BLANKS))
    slim = cut(rows.select("conv_id", "turn", *tie_keys(), "copy", F.substring("role", 1, 1).alias("initial"), (F.length(end) == 0).alias("_blank"), (~F.right(end, F.lit(1)).isin(*STOPS)).alias("_short")))
    placed = cut(numbered(slim, slim.count()))
    key = ["conv_id", "_hi", "_lo"]
    again = placed.groupBy(*key).agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").withColumnsRenamed({k: f"{k}2" for k in key})
    same = F.col("conv_id").eqNullSafe(F.col("conv_id2")) & (F.col("_hi") == F.col("_hi2")) & (F.col("_lo") == F.col("_lo2"))
    fault = F.when(F.col("_blank"), "blank").when(F.col("_at") > F.col("_first"), "duplicate").when(F.col("_short"), "truncated")
    found = placed.join(again, same, "left").withColumn("fault", fault)
    who = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper(who)).otherwise(who)
    return found.select("conv_id", "turn", "_at", "initial", "fault", symbol.alias("symbol"))


def shapes(marked: DataFrame) -> DataFrame:
    """``conv_id, shape, initials`` and the counts of each conversation: ``blank, duplicate, truncated, gaps, illegal``."""
    run = F.floor(F.col("_at") / RUN_ROWS)
    count = lambda f: F.sum((F.col("fault") == f).cast("long")).alias(f)
    turns = marked.groupBy("conv_id", "turn").agg(F.lit(1).alias("_one")).groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    runs = marked.groupBy("conv_id", run.alias("_run")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "symbol"))), lambda x: x["symbol"]), "").alias("_part"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", letter.alias("letter")))), lambda x: x["letter"]), "").alias("_who"),
        *map(count, ("blank", "duplicate", "truncated")),
    )
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_run", c))), lambda x: x[c]), "")
    whole = runs.groupBy("conv_id").agg(joined("_part").alias("shape"), joined("_who").alias("_who"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated")])
    # neighbours in order: two letters from every place but the last; the allowed pairs do not overlap in a way that hides one
    legal = F.regexp_count("_who", F.lit("(?=su|ua|au)"))
    whole = whole.withColumn("illegal", (F.length("_who") - 1 - legal).cast("long")).drop("_who")
    turns = turns.select(F.col("conv_id").alias("_id"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))
    return whole.join(turns, F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")


def repair_rules(shapes_: DataFrame, rounds: int = ROUNDS, per_round: int = RULES) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Re-Pair over a table ``shape, n``: the shapes with ``coded``, and the rules ``symbol, left, right``.

    Each round counts the pairs of all shapes by how many conversations have them and replaces the most frequent ones, none of
    which shares a symbol's role with another, until no pair occurs twice. The driver sees ``per_round`` pairs a round.
    """
    coded, rules = shapes_.withColumn("coded", F.col("shape")), []
    for _ in range(rounds):
        pairs = coded.select("n", F.explode(F.regexp_extract_all("coded", F.lit("(?=(..))"), F.lit(1))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
        top = [r["pair"] for r in pairs.where("n > 1").orderBy(F.desc("n"), "pair").limit(per_round).collect()]
        taken, chosen = set(), []
        for a, b in top:
            # disjoint symbols, so that the order of replacements does not matter
            if not {a, b} & taken:
                chosen.append((chr(RULE + len(rules) + len(chosen)), a, b))
                taken |= {a, b}
        if not chosen:
            break
        new = F.col("coded")
        for s, a, b in chosen:
            new = F.replace(new, F.lit(a + b), F.lit(s))
        rules += chosen
        coded = cut(coded.withColumn("coded", new))
    return coded, rules


def solutions(found: DataFrame) -> DataFrame:
    """``shape, cost, audit`` of every different shape."""
    different = cut(found.groupBy("shape").agg(F.count("*").alias("n")))
    coded, rules = repair_rules(different)
    # nine symbols and a bounded number of rules
    sent = share(found.sparkSession, matrices(rules))

    def make():
        known = sent()
        return lambda rows: list(map(list, zip(*[solved(r, known) for r in rows], strict=True))) if rows else [[], []]

    return cut(add_columns(coded, "coded", make, [("cost", T.LongType()), ("audit", T.StringType())]).select("shape", "cost", "audit"))


def repaired_digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the repaired ``role:text`` lines of every conversation in ``audits``.

    A conversation's audit comes before its rows in one sorted stream, so that a task holds an audit and one batch of rows.
    """
    bounded(rows.sparkSession)
    empty = lambda kinds: [F.lit(None).cast(k).alias(n) for n, k in kinds]
    key = [("turn", "long"), ("_role", "string"), ("_text", "string"), ("_hi", "long"), ("_lo", "long")]
    heads = audits.select("conv_id", F.lit(0).alias("_line"), *empty(key), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    lines = rows.select("conv_id", F.lit(1).alias("_line"), F.col("turn").cast("long").alias("turn"), *tie_keys(), "role", "text")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stream = heads.unionByName(lines).repartition(n, "conv_id").sortWithinPartitions("conv_id", "_line", *TURN_ORDER).select("conv_id", "_line", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        digests: list[str] = []
        state, audit, at, spoke, lines = None, "", 0, "", 0

        def line(role: str, text: str) -> None:
            nonlocal spoke, lines
            state.update(("\n" if lines else "").encode() + role.encode() + b":" + text.encode())
            spoke, lines = role[:1], lines + 1

        def insert() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                line("assistant" if spoke == "u" else "user", "")
                at += 1

        def close() -> None:
            if state is not None:
                insert()
                digests.append(state.hexdigest())

        for b in batches:
            for c, kind, role, text in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if kind == 0:
                    close()
                    ids.append(c)
                    state, audit, at, spoke, lines = hashlib.sha256(), text, 0, "", 0
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit == "K":
                    line(role, text)
                elif edit == "R":
                    line("assistant" if spoke == "u" else "user", text)
            while len(digests) >= 1024:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:1024], pa.int64()), pa.array(digests[:1024])], names=["conv_id", "repaired_sha256"])
                ids, digests = ids[1024:], digests[1024:]
        close()
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests)], names=["conv_id", "repaired_sha256"])

    return stream.mapInArrow(run, "conv_id long, repaired_sha256 string")


def repaired(rows: DataFrame, originals: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the repaired text of every conversation of ``originals`` (``conv_id``), given its ``rows``.

    ``rows`` holds ``conv_id, turn, role, text``, without nulls in role and text, and ``copy``. A null turn comes first; rows of
    one turn go by role, then text; a null conv_id is a conversation. Conversations without rows have zeros, an empty audit
    and the digest of the empty string.
    """
    found = cut(shapes(symbols(rows)))
    best = found.join(solutions(found), "shape").drop("shape")
    best = cut(best)
    done = repaired_digests(rows, best.select("conv_id", "audit")).withColumnRenamed("conv_id", "_done")
    whole = best.join(done, F.col("conv_id").eqNullSafe(F.col("_done"))).drop("_done").withColumnRenamed("conv_id", "_id")
    out = originals.select("conv_id").distinct().join(whole, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage and repair of all ``conversations``, one row for every original conv_id.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``. Nulls read as one space, a null turn comes
    first, rows of one turn go by role, then text; a null conv_id is a conversation; an empty table gives an empty one.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repaired(damaged(rows), rows)


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _more(way: str, cost: str, letters: str) -> str:
    return f"{{'c': {way}.c + {cost}, 'a': {way}.a || '{letters}'}}"


def _steps_sql() -> str:
    """One row of the recursion: insertions before the row, then what may be done with it. A cost of a billion is no way."""
    enter = [
        "v0", "v1",
        _least("v2", _more("v0", "2", "I"), _more("v1", "2", "I"), _more("v3", "2", "I")),
        _least("v3", _more("v0", "4", "II"), _more("v1", "4", "II"), _more("v2", "2", "I")),
    ]
    keep = lambda w, who: _more(w, f"case when keep = '{who}' then short else 1000000000 end", "K")
    again = lambda w: _more(w, "case when keep = 'x' then 1000000000 else 2 + short end", "R")
    to_user = [f(w) for w in ("w0", "w1", "w3") for f in (lambda x: keep(x, "u"), again)]
    leave = [_more("w0", "3", "D"), _least(_more("w1", "3", "D"), keep("w0", "s")), _least(_more("w2", "3", "D"), *to_user), _least(_more("w3", "3", "D"), keep("w2", "a"), again("w2"))]
    first = ", ".join(f"{x} as w{i}" for i, x in enumerate(enter))
    then = ", ".join(f"{x} as v{i}" for i, x in enumerate(leave))
    return f"select conv_id, k + 1 as k, {then} from (select st.conv_id, st.k, sy.keep, sy.short, {first} from st join sy on sy.conv_id is not distinct from st.conv_id and sy.k = st.k + 1) z"


_NONE = "{'c': 1000000000::bigint, 'a': ''}"
OP12_SQL = f"""
with recursive o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, cast({CRC_SQL.format("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as int) as kind from conversations),
da as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text from o, (select unnest([1, 2]) as copy) c where kind <> 0 and (copy = 1 or kind = 3)),
nu as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from da),
fa as (select *, regexp_replace(text, '[ \t\n\x0b\f\r]+$', '') as full_, min(k) over (partition by conv_id, role, text) as first_ from nu),
fb as (select *, case when full_ = '' then 'blank' when k > first_ then 'duplicate' when right(full_, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault, left(role, 1) as ini from fa),
sy as (select conv_id, k, case when fault in ('blank', 'duplicate') then 'x' when ini in ('s', 'u', 'a') then ini else 'o' end as keep, case when fault = 'truncated' then 1 else 0 end as short from fb),
st(conv_id, k, v0, v1, v2, v3) as (select distinct conv_id, 0::bigint, {{'c': 0::bigint, 'a': ''}}, {_NONE}, {_NONE}, {_NONE} from sy union all {_steps_sql()}),
n as (select conv_id, max(k) as n from sy group by conv_id),
be as (select st.conv_id, {_least("v0", "v3", _more("v2", "2", "I"), _more("v1", "4", "II"))} as best from st join n on n.conv_id is not distinct from st.conv_id and n.n = st.k),
le as (select conv_id, best.a as audit, unnest(generate_series(1, length(best.a))) as i from be),
lt as (select conv_id, i, audit[i] as letter, sum(case when audit[i] <> 'I' then 1 else 0 end) over w as k, sum(case when audit[i] <> 'D' then 1 else 0 end) over w as spot from le window w as (partition by conv_id order by i)),
lr as (select lt.*, fb.role, case when letter = 'I' then '' else fb.text end as text, ini, max(case when spot = 1 and letter = 'K' and ini = 's' then 1 else 0 end) over (partition by lt.conv_id) as sys from lt left join fb on fb.conv_id is not distinct from lt.conv_id and fb.k = lt.k and letter <> 'I'),
re as (select conv_id, string_agg(case when letter = 'K' then role when (spot - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by i) filter (where letter <> 'D') as whole from lr group by conv_id),
ad as (select conv_id, ini || lead(ini) over (partition by conv_id order by k) as pair, k, lead(k) over (partition by conv_id order by k) as after from fb),
il as (select conv_id, count(*) filter (where after is not null and pair not in ('su', 'ua', 'au')) as illegal from ad group by conv_id),
co as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated from fb group by conv_id)
select a.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(whole, '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join co on co.conv_id is not distinct from a.conv_id left join il on il.conv_id is not distinct from a.conv_id
left join be on be.conv_id is not distinct from a.conv_id left join re on re.conv_id is not distinct from a.conv_id"""
