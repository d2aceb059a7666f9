"""Chat formatting: least-cost repair of role sequences by dynamic programming, then rendering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import aside, cut, restored, small, table

#: States: nothing yet, or the role of the last turn. A legal sequence is an optional system turn, then
#: user and assistant in turn, the user first; it may end with either, or be a system turn alone.
ROLES = ("", "system", "user", "assistant")
LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
#: Other names of the roles, lower-cased.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Costs: joining a turn to one of its role, giving it another role (to or from system: more), an empty turn.
MERGE, RELABEL, RELABEL_SYSTEM, INSERT = 1, 2, 4, 3
#: Turns in a chunk; a long conversation is solved in chunks side by side.
CHUNK = 512
NEVER = 1 << 40


def _path(p: int, q: int) -> list[int] | None:
    """Empty turns to insert between a turn of state p and one of role q: the fewest, or None."""
    paths = [[]]
    for _ in range(3):
        for path in paths:
            if ((path[-1] if path else p), q) in LEGAL:
                return path
        paths = [[*path, r] for path in paths for r in (1, 2, 3) if ((path[-1] if path else p), r) in LEGAL]
    return None


def _step(p: int, q: int) -> int:
    if p == q and p:
        return MERGE
    path = _path(p, q)
    return NEVER if path is None else INSERT * len(path)


def _relabel(r: int, q: int) -> int:
    """Cost for a turn of role r (0: none of the known ones) to take role q."""
    return 0 if r == q else RELABEL_SYSTEM if 1 in (r, q) else RELABEL


#: MOVES[r][p][q]: cost of a turn of role r taking role q after state p.
MOVES = [[[NEVER if not q else min(NEVER, _step(p, q) + _relabel(r, q)) for q in range(4)] for p in range(4)] for r in range(4)]


def number_of(role: Column) -> Column:
    """0 for a role that is none of the known ones."""
    name = F.lower(F.trim(role))
    out = F.lit(0)
    for k, v in {**{r: r for r in ROLES[1:]}, **ALIASES}.items():
        out = F.when(name == k, ROLES.index(v)).otherwise(out)
    return out


def forward(roles: list[int], cost: list[int]) -> list[list[int]]:
    """Least cost of each state before the first turn and after each."""
    out = [cost]
    for r in roles:
        move, last = MOVES[r], out[-1]
        out.append([min(min(last[p] + move[p][q] for p in range(4)), NEVER) for q in range(4)])
    return out


def _back(roles: list[int], costs: list[list[int]], q: int) -> list[int]:
    """The states before the first turn and after each on the least-cost way to q; of equal ways the one with the lowest roles, the last turn deciding first."""
    way = [q]
    for k in range(len(roles) - 1, -1, -1):
        q = next(p for p in range(4) if costs[k][p] + MOVES[roles[k]][p][q] == costs[k + 1][q])
        way.append(q)
    return way[::-1]


def solve(roles: list[int]) -> list[int]:
    """The states of a whole conversation, the one before it included."""
    costs = forward(roles, [0, NEVER, NEVER, NEVER])
    return _back(roles, costs, min(range(4), key=lambda x: (costs[-1][x], x)))


class Span:
    """A run of turns of one conversation between states: least costs, and which entry wins among equals.

    cost[4 * p + q] is the least cost from p to q. rank[4 * p + q] orders the entries p by their way to q, by its last
    state, then the one before and so on, and at last by p itself: the same rule as solve() has, so that results don't
    depend on where a conversation is cut.
    """

    def __init__(self, cost: list[int], rank: list[int]):
        self.cost, self.rank = cost, rank

    @staticmethod
    def of(roles: list[int]) -> tuple[Span, list[list[int] | None]]:
        """The span of turns, and the way for each pair of states (None: there is none)."""
        ways: list[list[int] | None] = [None] * 16
        cost = [NEVER] * 16
        for p in range(4):
            costs = forward(roles, [0 if x == p else NEVER for x in range(4)])
            for q in range(4):
                cost[4 * p + q] = costs[-1][q]
                if costs[-1][q] < NEVER:
                    ways[4 * p + q] = _back(roles, costs, q)
        rank = [0] * 16
        for q in range(4):
            order = sorted(range(4), key=lambda p: (ways[4 * p + q] is None, (ways[4 * p + q] or [])[:0:-1], p))
            for i, p in enumerate(order):
                rank[4 * p + q] = i
        return Span(cost, rank), ways

    def then(self, after: Span) -> Span:
        """Both spans as one."""
        cost, key = [NEVER] * 16, [(4, 4)] * 16
        for p in range(4):
            for q in range(4):
                best = min((self.cost[4 * p + m] + after.cost[4 * m + q], after.rank[4 * m + q], m) for m in range(4))
                if best[0] < NEVER:
                    cost[4 * p + q], key[4 * p + q] = best[0], (best[1], self.rank[4 * p + best[2]])
        rank = [0] * 16
        for q in range(4):
            for i, p in enumerate(sorted(range(4), key=lambda p: (cost[4 * p + q] >= NEVER, key[4 * p + q], p))):
                rank[4 * p + q] = i
        return Span(cost, rank)


def ends_of(spans: list[Span], entry: int, leave: int | None) -> list[list[int]]:
    """Entry and leaving state of each of the spans, in order, on the least-cost way from entry to leave (None: any)."""
    costs = [[0 if p == entry else NEVER for p in range(4)]]
    for s in spans:
        costs.append([min(min(costs[-1][p] + s.cost[4 * p + q] for p in range(4)), NEVER) for q in range(4)])
    q = min(range(4), key=lambda x: (costs[-1][x], x)) if leave is None else leave
    out = []
    for k in range(len(spans) - 1, -1, -1):
        s = spans[k]
        p = min((p for p in range(4) if costs[k][p] + s.cost[4 * p + q] == costs[k + 1][q]), key=lambda p: s.rank[4 * p + q])
        out.append([p, q])
        q = p
    return out[::-1]


_MADE = "part int, chunk long, p int, q int, last boolean, ways binary, cost_of array<long>, rank_of array<int>, span_cost array<long>, span_rank array<int>"


def _walked(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Rows of a part in order of conversation and turn, with what can be said of each from this part alone.

    A conversation that begins and ends in the part and isn't longer than a chunk is solved: p and q are the states before
    and after each turn. The part's first and last conversation may go on elsewhere, so they and long ones are
    open: each row has the states for all 16 pairs of states at its chunk's ends (ways: 16 bytes before the turn, 16 after),
    a chunk's last row has the chunk's span, and the last row of the conversation in this part has the part's span.
    """
    from pyspark import TaskContext

    part, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []  # rows of the chunk that is being gathered
    roles: list[int] = []
    first, span, long = True, None, False  # the part's first conversation; the span of the current one's chunks so far; whether it is open

    def flush(over: bool, known_end: bool) -> pa.RecordBatch:
        """The gathered rows with their columns; over: the conversation's last ones in this part; known_end: and of all."""
        nonlocal held, roles, span, number
        n, table = len(roles), pa.Table.from_batches(held).combine_chunks()
        none = lambda: [None] * n
        p, q, last, ways, cost, rank, span_cost, span_rank = none(), none(), none(), none(), none(), none(), none(), none()
        if over and known_end and not first and not long:
            way = solve(roles)
            p, q, last = way[:-1], way[1:], [False] * (n - 1) + [True]
        else:
            own, found = Span.of(roles)
            states = np.array([w if w is not None else [0] * (n + 1) for w in found], np.uint8)
            both = np.concatenate([states[:, :-1], states[:, 1:]]).T
            ways = [x.tobytes() for x in np.ascontiguousarray(both)]
            cost[-1], rank[-1] = own.cost, own.rank
            span = own if span is None else span.then(own)
            if over:
                span_cost[-1], span_rank[-1] = span.cost, span.rank
        made = [pa.array([part] * n, pa.int32()), pa.array([part << 32 | number] * n, pa.int64()), pa.array(p, pa.int32()), pa.array(q, pa.int32()), pa.array(last, pa.bool_()), pa.array(ways, pa.binary()), pa.array(cost, pa.list_(pa.int64())), pa.array(rank, pa.list_(pa.int32())), pa.array(span_cost, pa.list_(pa.int64())), pa.array(span_rank, pa.list_(pa.int32()))]
        names = [f.split()[0] for f in _MADE.split(", ")]
        batch = table.to_batches()[0]
        held, roles, number = [], [], number + 1
        return pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, alone, role = batch["__conv"].fill_null(0).to_numpy(), batch["__conv"].is_null().to_numpy(zero_copy_only=False), batch["__r"].to_numpy()
        new = np.concatenate([[True], (conv[1:] != conv[:-1]) | alone[1:] | alone[:-1]])
        ready = []
        for begin, end in zip(np.flatnonzero(new).tolist(), [*np.flatnonzero(new)[1:].tolist(), len(new)], strict=True):
            own = None if alone[begin] else int(conv[begin])
            if now is not None and (own is None or own != now[0]):  # the one before is over
                if roles:
                    ready.append(flush(True, True))
                first, span, long, now = False, None, False, None
            if now is None and own is None:
                first = False  # a turn alone is never open
            now = (own,)
            for k in range(begin, end, chunk):
                step = min(chunk, end - k)
                while step:
                    if len(roles) == chunk:
                        long = True
                        ready.append(flush(False, False))
                    take = min(step, chunk - len(roles))
                    at = min(chunk, end - k) - step + k
                    held.append(batch.slice(at, take))
                    roles += role[at : at + take].tolist()
                    step -= take
        if ready:
            yield from ready
    if roles:
        yield flush(True, now == (None,))


def _ends(spans, entry: int, leave: int | None) -> list[list[int]]:
    return ends_of([Span(list(c), list(r)) for c, r in spans], entry, leave)


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each turn: turns' columns, and new_role, action, inserted, cost, piece.

    Turns are dealt by range of conversation and order and sorted, so a hot conversation is spread over as many parts as it
    needs. One pass over the parts solves the conversations that lie in one part; of the others it
    gives a span for each `chunk` turns (least costs between states: the automaton's least-plus matrix) and
    one for each part. Those form a tree: a conversation's parts give the states at the parts' ends (a few numbers a
    part, as many as there are parts), those the states at the ends of each part's chunks, and those each row's own. So no
    row or task holds a whole conversation: the pieces of its turns, in order, are its rendered text. Of ways that cost the same
    the one with the lowest roles is taken, the last turn deciding first, wherever the parts are cut.

    Turns are ordered by turn (nulls last), then role and text. Null and unknown roles must take a known
    one; null texts are empty. A turn without a conv_id is a conversation alone. Repeated rows are
    separate turns (of one role, so they are merged), and are dealt apart by their place in the input, which is written
    first for that. A very long text is a row like another. Other columns pass through, but for those with the names
    of the results. An empty table gives an empty one. conv_id is taken as a long: a text that is no number is an error under
    Spark's ANSI rules, so other ids must be numbered before.
    """
    spark = turns.sparkSession
    added = ("new_role", "action", "inserted", "cost", "piece")
    own, back = aside(turns, ("conv_id", "turn", "role", "text"), added)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = cut(own.withColumns({"__conv": F.col("conv_id").cast("long"), "__r": number_of(F.coalesce("role", F.lit("")))}))
    order = [F.col("__conv").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_first(), F.col("__at")]
    dealt = base.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    walked = cut(dealt.mapInArrow(lambda batches: _walked(batches, chunk), f"{schema}, {_MADE}"))

    spans = lambda c, r, by: F.transform(F.sort_array(F.collect_list(F.struct(F.col(by).alias("k"), F.col(c).alias("c"), F.col(r).alias("r")))), lambda x: x)
    solved = F.udf(lambda found, entry, leave: _ends([(x["c"], x["r"]) for x in found], entry, leave), "array<array<int>>")
    of_parts = walked.filter("span_cost is not null").groupBy("__conv").agg(spans("span_cost", "span_rank", "part").alias("s"))  # as many as parts at most
    of_parts = of_parts.withColumn("e", solved("s", F.lit(0), F.lit(None).cast("int"))).select("__conv", F.size("s").alias("n"), F.posexplode(F.arrays_zip(F.col("s.k").alias("part"), F.col("e").alias("e"))).alias("at", "x"))
    of_parts = of_parts.select("__conv", F.col("x.part").alias("part"), F.col("x.e")[0].alias("entry"), F.col("x.e")[1].alias("leave"), (F.col("at") == F.col("n") - 1).alias("end"))
    of_chunks = walked.filter("cost_of is not null").select("__conv", "part", "chunk", "cost_of", "rank_of").join(small(cut(of_parts)), ["__conv", "part"])
    of_chunks = of_chunks.groupBy("__conv", "part").agg(spans("cost_of", "rank_of", "chunk").alias("s"), *(F.first(c).alias(c) for c in ("entry", "leave", "end")))  # the chunks of one part
    of_chunks = of_chunks.withColumn("e", solved("s", "entry", "leave")).select("end", F.size("s").alias("n"), F.posexplode(F.arrays_zip(F.col("s.k").alias("chunk"), F.col("e").alias("e"))).alias("at", "x"))
    states = cut(of_chunks.select(F.col("x.chunk").alias("__chunk"), F.col("x.e")[0].alias("entry"), F.col("x.e")[1].alias("leave"), (F.col("end") & (F.col("at") == F.col("n") - 1)).alias("end")))

    opened = walked.filter("ways is not null").join(small(states), F.col("chunk") == F.col("__chunk"))
    byte = lambda k: F.ascii(F.substring("ways", k, 1).cast("string"))
    pair = 4 * F.col("entry") + F.col("leave") + 1
    opened = opened.withColumns({"p": byte(pair), "q": byte(pair + 16), "last": F.col("end") & F.col("cost_of").isNotNull()})
    rows = walked.filter("ways is null").unionByName(opened.select(walked.columns))
    return restored(_told(rows), back, *added)


def _told(rows: DataFrame) -> DataFrame:
    """rows (__r, p, q, last, text) with the result's columns, from small tables of the automaton."""
    at = 4 * F.col("p") + F.col("q")
    array = lambda values: F.array(*map(F.lit, values))
    ways = [[] if p == q or not q else _path(p, q) or [] for p in range(4) for q in range(4)]
    empties = ["".join(f"<|{ROLES[x]}|>\n<|end|>\n" for x in way) for way in ways]
    begins = [("" if p == 0 else "<|end|>\n") + empties[4 * p + q] + f"<|{ROLES[q]}|>\n" if p != q else "\n\n" for p in range(4) for q in range(4)]
    changed, merged = F.col("__r") != F.col("q"), F.col("p") == F.col("q")
    return rows.withColumns({
        "new_role": array(ROLES)[F.col("q")],
        "action": F.when(changed & merged, "relabel+merge").when(changed, "relabel").when(merged, "merge").otherwise("keep"),
        "inserted": array([",".join(ROLES[x] for x in way) for way in ways])[at],
        "cost": array([x for r in MOVES for row in r for x in row])[16 * F.col("__r") + at].cast("long"),
        "piece": F.concat(array(begins)[at], F.coalesce("text", F.lit("")), F.when(F.col("last"), "<|end|>\n").otherwise("")),
    })


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return repair(turns).drop("text")


def _sql() -> str:
    """The same dynamic programme as recursive SQL: costs forward turn by turn, then states backward."""
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items())
    moves = ", ".join(f"({r}, {[x for row in MOVES[r] for x in row]})" for r in range(4))
    role = lambda c: "(" + str(list(ROLES)) + f")[{c} + 1]"
    ways = {(p, q): _path(p, q) for p in range(4) for q in range(1, 4) if p != q and _path(p, q)}
    inserted = "CASE " + " ".join(f"WHEN p = {p} AND q = {q} THEN '{','.join(ROLES[x] for x in w)}'" for (p, q), w in ways.items()) + " ELSE '' END"
    empties = "CASE " + " ".join(f"WHEN p = {p} AND q = {q} THEN '{''.join(f'<|{ROLES[x]}|>~<|end|>~' for x in w)}'" for (p, q), w in ways.items()) + " ELSE '' END"
    nl = "chr(10)"
    best = lambda q: f"least({NEVER}, list_min([{', '.join(f'f.c[{p + 1}] + m.m[{4 * p + q + 1}]' for p in range(4))}]))"
    from_ = ", ".join(f"f.c[{p + 1}] + m.m[{4 * p} + b.q + 1]" for p in range(4))
    return f"""
WITH RECURSIVE m(r, m) AS (VALUES {moves}),
named AS (SELECT *, CASE lower(trim(role)) {names} ELSE lower(trim(role)) END AS name FROM conversations),
t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, CASE name WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 0 END AS r,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS FIRST) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM named),
f AS (SELECT DISTINCT conv_id, 0::BIGINT AS k, [0, {NEVER}, {NEVER}, {NEVER}]::BIGINT[] AS c FROM t
      UNION ALL SELECT f.conv_id, f.k + 1, [{", ".join(best(q) for q in range(4))}]::BIGINT[] FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k + 1 JOIN m ON m.r = t.r),
b AS (SELECT f.conv_id, f.k, (list_position(f.c, list_min(f.c)) - 1)::BIGINT AS q, f.c AS c FROM f JOIN t ON t.conv_id = f.conv_id AND t.k = f.k AND t.k = t.n
      UNION ALL SELECT b.conv_id, b.k - 1, (list_position([{from_}], b.c[b.q + 1]) - 1)::BIGINT, f.c FROM b JOIN t ON t.conv_id = b.conv_id AND t.k = b.k JOIN m ON m.r = t.r JOIN f ON f.conv_id = b.conv_id AND f.k = b.k - 1),
j AS (SELECT t.*, x.q, y.q AS p, m.m[4 * y.q + x.q + 1] AS cost FROM t JOIN b x ON x.conv_id = t.conv_id AND x.k = t.k JOIN b y ON y.conv_id = t.conv_id AND y.k = t.k - 1 JOIN m ON m.r = t.r)
SELECT conv_id, turn, role, {role("q")} AS new_role, CASE WHEN r <> q AND p = q THEN 'relabel+merge' WHEN r <> q THEN 'relabel' WHEN p = q THEN 'merge' ELSE 'keep' END AS action,
       {inserted} AS inserted, cost::BIGINT AS cost,
       CASE WHEN p = q THEN {nl} || {nl} || text ELSE CASE WHEN p = 0 THEN '' ELSE '<|end|>' || {nl} END || replace({empties}, '~', {nl}) || '<|' || {role("q")} || '|>' || {nl} || text END
       || CASE WHEN k = n THEN '<|end|>' || {nl} ELSE '' END AS piece FROM j
"""


SQL = _sql()
