"""Chat formatting by quotation linking.

Lines that begin with ``>`` marks are quoted, one level per mark. Consecutive lines of one level are a quoted passage; the
lines between are the message's own passages. Passages are normalised and hashed. A quoted passage is linked to the
latest earlier message of the conversation with an own passage of that hash; else each of its lines is tried the same way,
which finds partly quoted passages. The reply goes to the message that its shallowest, latest link names, without
any link to the message before. Conversations come back as messages without quotes in thread order: every turn is followed by all that
answers it, the answers to one turn in turn order.

Turns that answer the turn before them are one run, so only the turns that answer another one (openings) make a tree. It is walked around
once, entering and leaving every run; where each step of the walk stands is found by doubling pointers, in as many rounds as the logarithm
of a conversation's openings, each a join on (conversation, opening). Without openings thread order is turn order.

Only DataFrame functions are used. Quotes and originals of a conversation meet in one pass over (conversation, hash, turn): the
latest original before a quote is a running maximum, so copies of a line in many messages do not multiply. A hash that
fills a conversation is cut into stretches of turns, and one row per stretch carries the maximum on.

Defined cases: null texts are empty; repeated rows with one (conversation, turn) are one message each and link alike; null conversation numbers are
a conversation; null turns come before all others; an empty message stays, with an empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panoloom.operators.segments import previous

from . import common as c

#: Marks at the beginning of a quoted line, blanks between them allowed.
MARKS = r"^[ \t]*((?:>[ \t]?)+)"
STRETCH = 256           # turns of a conversation that are put in order together


def normal(text: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def lines(messages: DataFrame) -> DataFrame:
    """``conv, turn, msg, pos, level, line, passage``: every line with its quote level and the number of its passage.

    ``msg`` tells repeated (conversation, turn) apart by text. A passage is a run of lines of one level without blank lines.
    """
    raw = F.split(c.text_of(), "\r?\n")
    cut = messages.select(
        F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.xxhash64(c.text_of(), F.coalesce("role", F.lit(""))).alias("msg"),
        F.transform(raw, lambda x: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", "")).alias("level"),
            F.regexp_replace(x, MARKS, "").alias("line"))).alias("rows"))
    same = cut.select("*", F.expr("""transform(rows, (x, i) -> if(i = 0 or trim(x.line) = '' or trim(get(rows, i - 1).line) = ''
                                     or get(rows, i - 1).level <> x.level, i, null))""").alias("starts"))
    out = same.select("conv", "turn", "msg", F.posexplode(F.arrays_zip("rows", "starts")).alias("pos", "x")).select(
        "conv", "turn", "msg", "pos", "x.rows.level", "x.rows.line", "x.starts")
    w = Window.partitionBy("conv", "turn", "msg").orderBy("pos")
    return out.withColumn("passage", F.last("starts", ignorenulls=True).over(w)).drop("starts")


def passages(rows: DataFrame) -> DataFrame:
    """``conv, turn, msg, level, hash, whole`` of all passages with words, and of each of their lines."""
    kept = rows.where(F.trim("line") != "")
    joined = kept.groupBy("conv", "turn", "msg", "passage", "level").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))
    whole = joined.select("conv", "turn", "msg", "level", F.xxhash64(normal(F.col("text"))).alias("hash"), F.lit(True).alias("whole"))
    each = kept.select("conv", "turn", "msg", "level", F.xxhash64(normal(F.col("line"))).alias("hash"), F.lit(False).alias("whole"))
    return whole.unionByName(each).distinct()


def links(found: DataFrame) -> DataFrame:
    """``conv, turn, msg, level, target``: the latest earlier turn whose own words a quoted passage repeats."""
    own = found.where("level = 0").select("conv", "hash", "turn", F.col("turn").alias("original")).distinct()
    quoted = found.where("level > 0").select("conv", "hash", "turn", "msg", "level", "whole")
    quoted_keys = quoted.select("conv", "hash").distinct()
    own = own.join(quoted_keys, own["conv"].eqNullSafe(quoted_keys["conv"]) & (own["hash"] == quoted_keys["hash"]), "left_semi")
    both = quoted.withColumn("original", F.lit(None).cast("long")).unionByName(
        own.select("conv", "hash", "turn", F.lit(None).cast("long").alias("msg"), F.lit(0).alias("level"), F.lit(False).alias("whole"), "original"))
    both = both.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    carry = both.groupBy("conv", "hash", "stretch").agg(F.max("original").alias("m"))
    before = Window.partitionBy("conv", "hash").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(F.col("conv").alias("c"), F.col("hash").alias("h"), F.col("stretch").alias("s"), F.max("m").over(before).alias("carried"))
    inside = Window.partitionBy("conv", "hash", "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("here", F.max("original").over(inside)).where("level > 0")
    both = both.join(carry, F.col("conv").eqNullSafe(F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("stretch") == F.col("s")))
    both = both.withColumn("target", F.coalesce("here", "carried")).where("target is not null")
    return both.select("conv", "turn", "msg", "level", "target", "whole")


def unquoted(text: Column) -> Column:
    """The text without its quoted lines and without white space at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?md)^[ \t]*(?:>[ \t]?)+[^\n]*\n?", ""), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _running(rows: DataFrame, sums: dict[str, tuple]) -> DataFrame:
    """Columns that run along a conversation's turns, one row each: name -> (aggregate, column, whether the own turn counts)."""
    rows = rows.withColumn("stretch", F.floor(F.col("turn") / STRETCH))
    w = Window.partitionBy("conv", "stretch").orderBy("turn")
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carry = rows.groupBy("conv", "stretch").agg(*[f(col).alias(f"__{n}") for n, (f, col, _) in sums.items()])
    carry = carry.select(F.col("conv").alias("__c"), F.col("stretch").alias("__s"), *[
        f(f"__{n}").over(before).alias(f"__{n}") for n, (f, _, _) in sums.items()])
    here = rows.select("*", *[f(col).over(w.rowsBetween(Window.unboundedPreceding, 0 if own else -1)).alias(n) for n, (f, col, own) in sums.items()])
    here = here.join(carry, F.col("conv").eqNullSafe(F.col("__c")) & (F.col("stretch") == F.col("__s")))
    merged = {F.max: F.greatest, F.min: F.least}
    return here.select(*rows.drop("stretch").columns, *[
        (F.col(n) + F.coalesce(f"__{n}", F.lit(0)) if f is F.sum else merged[f](n, f"__{n}")).alias(n) for n, (f, _, _) in sums.items()])


def _tour(runs: DataFrame, turns: DataFrame) -> DataFrame:
    """``key, node, leaves, to, to_leaves, dist``: the step after entering and after leaving each run, and the messages entered at it.

    After a run come the runs that hang on its last turn, then those on the turn before, so that each follows all deeper answers.
    """
    def stretch(x):
        return F.floor(F.col(x) / STRETCH)

    on = turns.select("key", F.col("turn").alias("attach"), F.col("branch").alias("parent"))
    hung = runs.where("attach is not null").join(on, ["key", "attach"]).select("key", "parent", "attach", "branch", (F.lit(-1) - F.col("branch")).alias("down"))
    hung = previous(hung, ["key", "attach"], ["down"], stretch("down"), ["branch"], "same_")
    first = hung.groupBy("key", "parent", "attach").agg(F.min("branch").alias("first"))
    lower = previous(first, ["key", "parent"], ["attach"], stretch("attach"), ["first"], "lower_").select("key", "attach", "lower_first")
    deepest = first.groupBy(F.col("key"), F.col("parent").alias("branch")).agg(F.max_by("first", "attach").alias("child"))
    enter = runs.join(deepest, ["key", "branch"], "left").select(
        "key", F.col("branch").alias("node"), F.lit(False).alias("leaves"), F.coalesce("child", "branch").alias("to"), F.col("child").isNull().alias("to_leaves"),
        F.col("size").alias("dist"))
    beside = F.coalesce("same_branch", "lower_first")
    leave = hung.join(lower, ["key", "attach"]).select(
        "key", F.col("branch").alias("node"), F.lit(True).alias("leaves"), F.coalesce(beside, "parent").alias("to"), beside.isNull().alias("to_leaves"), F.lit(0).alias("dist"))
    roots = runs.where("attach is null").select(
        "key", F.col("branch").alias("node"), F.lit(True).alias("leaves"), F.lit(None).cast("long").alias("to"), F.lit(None).cast("boolean").alias("to_leaves"),
        F.lit(0).alias("dist"))
    return enter.unionByName(leave).unionByName(roots)


def starts(runs: DataFrame, turns: DataFrame) -> tuple[DataFrame, int]:
    """``key, branch, start``: the messages before each run in thread order, and the rounds of doubling it took.

    ``runs`` is ``key, branch, attach, size``: the opening turn, the turn it answers (null for a conversation's first run) and the messages.
    """
    steps, rounds = c.stored(_tour(runs, turns), "tour"), 0
    while not steps.where("to is not null").isEmpty():
        ahead = steps.select("key", F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("next"), F.col("to_leaves").alias("next_leaves"),
                             F.col("dist").alias("more"))
        rest = steps.where("to is not null").join(ahead, ["key", "to", "to_leaves"])
        rest = rest.select("key", "node", "leaves", F.col("next").alias("to"), F.col("next_leaves").alias("to_leaves"), (F.col("dist") + F.col("more")).alias("dist"))
        steps, rounds = c.stored(steps.where("to is null").unionByName(rest), "tour"), rounds + 1
    whole = runs.groupBy("key").agg(F.sum("size").alias("whole"))
    return steps.where(~F.col("leaves")).join(whole, "key").select("key", F.col("node").alias("branch"), (F.col("whole") - F.col("dist")).alias("start")), rounds


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, text, reply_to, linked, n_quoted, max_level, branch, position``.

    ``text`` has no quotes. ``linked`` says that a quote names ``reply_to``, which else is the turn before. A link to any other turn opens a
    branch, which the messages after it continue; ``branch`` is the turn that opened it. ``position`` counts a conversation's messages
    in thread order from 1; messages of one turn stay together and share the position of the last. A turn whose
    messages answer different turns stands with the answers to the earliest.
    """
    key = [F.col("conv_id").cast("long").alias("conv"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
           F.xxhash64(c.text_of(), F.coalesce("role", F.lit(""))).alias("msg")]
    clean = messages.select(*key, F.col("turn").isNull().alias("no_turn"), "role", unquoted(c.text_of()).alias("text"))
    some = lines(messages.select("conv_id", "turn", "role", "text").where(F.contains(c.text_of(), F.lit(">"))).distinct())
    other = lines(messages.select("conv_id", "turn", "role", "text").distinct())
    quoted = some.where("level > 0").groupBy("conv", "turn", "msg").agg(F.count(F.lit(1)).alias("n_quoted"), F.max("level").cast("long").alias("max_level"))
    best = F.max(F.struct("whole", (-F.col("level")).alias("l"), "target"))
    found = links(passages(other)).groupBy("conv", "turn", "msg").agg(best.alias("best"))
    about = c.stored(quoted.join(
        found, quoted["conv"].eqNullSafe(found["conv"]) & (quoted["turn"] == found["turn"]) & (quoted["msg"] == found["msg"]), "left").select(
        quoted["conv"].alias("qc"), quoted["turn"].alias("qt"), quoted["msg"].alias("qm"), "n_quoted", "max_level", F.col("best.target").alias("target")), "quotes")
    turns = _running(messages.select(*key[:2]).groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n")),
                     {"prev": (F.max, "turn", False), "upto": (F.sum, "n", True), "first_turn": (F.min, "turn", True)})
    earliest = about.groupBy("qc", "qt").agg(F.min("target").alias("earliest"))
    turns = turns.join(earliest, turns["conv"].eqNullSafe(F.col("qc")) & (turns["turn"] == F.col("qt")), "left").drop("qc", "qt")
    turns = turns.withColumn("attach", F.when(F.col("earliest") < F.col("prev"), F.col("earliest"))).drop("earliest")
    turns = _running(turns.withColumn("opens", F.when(F.col("attach").isNotNull(), F.col("turn"))), {"opened": (F.max, "opens", True)})
    turns = turns.select(F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("key"), "conv", "turn", "n", "prev", "upto", "attach",
                         F.coalesce("opened", "first_turn").alias("branch"))
    if about.where("target is not null").isEmpty():
        turns = turns.withColumn("position", F.col("upto"))
    else:
        turns = c.stored(turns, "turns")
        runs = turns.groupBy("key", "branch").agg(F.max("attach").alias("attach"), F.sum("n").alias("size"), F.min(F.col("upto") - F.col("n")).alias("base"))
        where = starts(runs, turns)[0].join(runs.select("key", "branch", "base"), ["key", "branch"])
        turns = turns.join(where, ["key", "branch"]).withColumn("position", F.col("start") + F.col("upto") - F.col("base"))
    turns = turns.select(F.col("conv").alias("tc"), F.col("turn").alias("tt"), "prev", "branch", "position")
    rows = clean.join(turns, clean["conv"].eqNullSafe(F.col("tc")) & (clean["turn"] == F.col("tt")))
    rows = rows.join(about, rows["conv"].eqNullSafe(F.col("qc")) & (rows["turn"] == F.col("qt")) & (rows["msg"] == F.col("qm")), "left")
    return rows.select(F.col("conv").alias("conv_id"), F.when(~F.col("no_turn"), F.col("turn")).alias("turn"), "role", "text",
                       F.coalesce("target", "prev").alias("reply_to"), F.col("target").isNotNull().alias("linked"),
                       F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"),
                       "branch", F.col("position").cast("long").alias("position"))


def quoting(messages: DataFrame) -> DataFrame:
    """The messages with quotes of earlier ones before their words, one to three turns back, and in every third of a deeper level."""
    said = messages.where("text is not null").groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.max("text").alias("said"))
    rows = messages.select("conv_id", "turn", "role", "text", F.when(F.expr("(conv_id + turn) % 4 > 0"), F.expr("turn - 1 - (conv_id + turn) % 3")).alias("back"),
                           F.when(F.expr("(conv_id + turn) % 3 = 0"), F.expr("turn - 4")).alias("deep"))
    for at in ("back", "deep"):
        rows = rows.join(said.withColumnRenamed("said", f"{at}_said"), (F.col("conv_id") == F.col("c")) & (F.col(at) == F.col("t")), "left").drop("c", "t")

    def quote(col, marks):
        return F.coalesce(F.concat(F.lit(f"{marks} "), F.replace(F.col(col), F.lit("\n"), F.lit(f"\n{marks} ")), F.lit("\n")), F.lit(""))
    return rows.select("conv_id", "turn", "role", F.concat(quote("deep_said", ">>"), quote("back_said", ">"), c.text_of()).alias("text"))


def op4_quotation(spark, sf_dir):
    """All conversations without quotes, with what each message answers."""
    return conversations(c.read(spark, sf_dir, "conversations"))


def quoted_threads(spark, sf_dir):
    """The same of conversations whose messages quote earlier ones."""
    return conversations(quoting(c.read(spark, sf_dir, "conversations")))


def sql(table: str = "conversations") -> str:
    norm = r"trim(regexp_replace(lower({}), '[\x20\x09-\x0D]+', ' ', 'g'))"
    marks = r"'^[ \t]*((?:>[ \t]?)+)'"
    return rf"""
with recursive m as (select conv_id as conv, coalesce(turn, -1) as turn, turn is null as no_turn, role, coalesce(text, '') as text from {table}),
d as (select distinct conv, turn, coalesce(role, '') as role, text from m),
l as (select conv, turn, role, text, unnest(string_split(text, chr(10))) as raw, unnest(range(len(string_split(text, chr(10))))) as pos from d),
q as (select *, length(regexp_replace(regexp_extract(raw, {marks}, 1), '[^>]', '', 'g')) as level, regexp_replace(raw, {marks}, '') as line from l),
k as (select *, case when coalesce(trim(line) = '' or trim(lag(line) over w) = '' or lag(level) over w <> level, true) then pos end as s
      from q window w as (partition by conv, turn, role, text order by pos)),
g as (select *, last_value(s ignore nulls) over (partition by conv, turn, role, text order by pos) as passage from k),
p as (select conv, turn, role, text, level, {norm.format("string_agg(line, ' ' order by pos)")} as key, true as whole
      from g where trim(line) <> '' group by conv, turn, role, text, passage, level
      union all select conv, turn, role, text, level, {norm.format("line")}, false from g where trim(line) <> ''),
o as (select distinct conv, turn, key from p where level = 0),
t as (select a.conv, a.turn, a.role, a.text, a.level, a.whole, max(o.turn) as target from p a join o
      on a.conv is not distinct from o.conv and a.key = o.key and o.turn < a.turn where a.level > 0 group by all),
b as (select * from t qualify row_number() over (partition by conv, turn, role, text order by whole desc, level, target desc) = 1),
n as (select conv, turn, role, text, count(*) as n_quoted, max(level) as max_level from q where level > 0 group by all),
r as (select m.*, b.target, n.n_quoted, n.max_level,
             max(m.turn) over (partition by m.conv order by m.turn range between unbounded preceding and 1 preceding) as prev,
             min(m.turn) over (partition by m.conv) as first_turn
      from m left join b on m.conv is not distinct from b.conv and m.turn = b.turn and coalesce(m.role, '') = b.role and m.text = b.text
             left join n on m.conv is not distinct from n.conv and m.turn = n.turn and coalesce(m.role, '') = n.role and m.text = n.text),
h as (select conv, turn, count(*) as n, case when min(target) < max(prev) then min(target) else max(prev) end as parent from r group by all),
v as (select conv, turn, n, [turn] as path from h where parent is null union all
      select h.conv, h.turn, h.n, list_append(v.path, h.turn) from h join v on h.conv is not distinct from v.conv and h.parent = v.turn),
z as (select conv as zc, turn as zt, cast(sum(n) over (partition by conv order by path) as bigint) as position from v)
select conv as conv_id, case when no_turn then null else turn end as turn, role,
       regexp_replace(regexp_replace(text, '(?m)^[ \t]*(?:>[ \t]?)+[^\n]*\n?', '', 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') as text,
       coalesce(target, prev) as reply_to, target is not null as linked, cast(coalesce(n_quoted, 0) as bigint) as n_quoted,
       cast(coalesce(max_level, 0) as bigint) as max_level,
       coalesce(max(case when target <> prev then turn end) over (partition by conv order by turn), first_turn) as branch, position
from r join z on conv is not distinct from zc and turn = zt"""


QUOTING = """
(with s as (select conv_id as c, turn as t, max(text) as said from conversations where text is not null group by all)
 select m.conv_id, m.turn, m.role, coalesce('>> ' || replace(d.said, chr(10), chr(10) || '>> ') || chr(10), '')
        || coalesce('> ' || replace(b.said, chr(10), chr(10) || '> ') || chr(10), '') || coalesce(m.text, '') as text
 from conversations m
      left join s b on b.c = m.conv_id and b.t = m.turn - 1 - (m.conv_id + m.turn) % 3 and (m.conv_id + m.turn) % 4 > 0
      left join s d on d.c = m.conv_id and d.t = m.turn - 4 and (m.conv_id + m.turn) % 3 = 0)"""

QUERIES = {"op4_quotation": op4_quotation, "quoted_threads": quoted_threads}
ORACLE = {"op4_quotation": sql(), "quoted_threads": sql(QUOTING)}
