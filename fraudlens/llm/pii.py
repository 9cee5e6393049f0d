"""Personal data by bootstrapped contextual extraction (operator 8).

The base patterns find e-mail addresses, IP addresses, payment cards and
phone numbers with exact rules; these spans always stay and are the seeds.
Every identifier-like token (it has a digit or an ``@``), or run of spaced
numbers, is an instance; the word before it and the word after it are its two
lexical patterns, whatever its shape, which chooses among the kinds. Each
word with the shape is a pattern too, for words that other numbers share. Spark scores the graph of patterns and instances:

* a pattern's confidence is the mean score of its occurrences, smoothed by
  ``SMOOTHING`` failures; it needs ``SUPPORT`` known instances;
* seeds are known and score 1; an instance with a pattern of at least
  ``CONFIDENT`` is known from then on, of the kind that its shape fits and
  that most known instances of its best pattern have, and scores that
  pattern's confidence; others score 0;

``ROUNDS`` times over, so patterns found by known instances find further ones
and no round loses what an earlier one found. An occurrence with a confident
pattern of its own is a new span, wherever else its instance occurs.

Tokens with digits are few, so the graph is small against the texts: texts
are scanned in place and only tokens with their neighbours are shuffled.
Edges are summed before each exchange; a pattern with a third of all edges
(joined with its one score) is split by Spark's skewed-join handling.

Defined results: null and empty texts have no spans; equal rows get equal
spans; offsets are code points, ends exclusive; discovered spans never
overlap base spans; without seeds nothing is discovered; extra columns are
kept by ``mask`` and otherwise ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import SPACE_CLASS, WORD_CLASS, identity, let, lower_ascii, written

#: Kinds in order, and their patterns. They match what the plain
#: patterns of the contract match; possessive repeats and the anchor (a run's
#: start or the end of the match before) keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a kind's pattern to be tried at all.
GATES = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
TOKEN = rf"(?<!{WORD_CLASS})[^\x20\x09-\x0D0-9@]*+[0-9@]{WORD_CLASS}*+"
#: An identifier without the punctuation around it (an area code in
#: parentheses keeps them), and what is before it.
CORE = r"(?s)(?:\((?=[0-9]+\).)|[\p{L}\p{N}+@])(?:.*[\p{L}\p{N}])?"
LEAD = r"(?s)^(?:(?!\([0-9]+\).)[^\p{L}\p{N}+@])*"

ROUNDS = 3
SMOOTHING = 2.0
SUPPORT = 5
CONFIDENT = 0.8
#: Neighbouring words and shapes of more code points are told by a hash.
CONTEXT = 40

SPAN = "array<struct<start:int,kind:int,end:int>>"


#: Numbers of a piece that a scan adds up one by one.
PIECE = 64


def plus(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def held(names: list[str], body) -> Column:
    """``body`` of columns that it uses inside lambdas: evaluated once, though
    Spark may put a column's expression in its place."""
    def bind(left, values):
        return let(F.col(left[0]), lambda v: bind(left[1:], [*values, v])) if left else body(*values)
    return bind(names, [])


def steps(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def scan(df: DataFrame, numbers: list[str], op) -> DataFrame:
    """Replaces each array of numbers by, for each number, ``op`` (a sum or a
    maximum) of those before it, 0 for the first. An array that grows by a fold
    is copied at each step, so arrays are cut into pieces, and the pieces'
    totals into pieces again: the work is linear up to ten million numbers."""
    def own(a):
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(a, begin, lambda acc, x: F.struct(
            op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])

    def pieces(name):
        def cut(a):
            n = F.size(a)
            return F.when(n > 0, F.transform(
                F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int")), lambda i: F.transform(
                    F.sequence(i * PIECE, F.least(i * PIECE + PIECE, n) - 1), lambda k: F.get(a, k)))
                ).otherwise(F.array().cast("array<array<int>>"))
        return held([name], cut)

    def totals(a):
        return F.transform(a, lambda c: F.aggregate(c, F.lit(0), op))

    def joined(cut, starts):
        return held([starts], lambda held_starts: F.flatten(F.transform(cut, lambda c, i: F.transform(
            own(c), lambda x: op(x, F.get(held_starts, i))))))

    low, sums, high, tops, mids = ([f"__{c}_{k}" for c in numbers] for k in ("low", "sums", "high", "tops", "mids"))
    out = df.withColumns({x: pieces(c) for x, c in zip(low, numbers)})
    out = out.withColumns({x: totals(F.col(c)) for x, c in zip(sums, low)})
    out = out.withColumns({x: pieces(c) for x, c in zip(high, sums)})
    out = out.withColumns({x: own(totals(F.col(c))) for x, c in zip(tops, high)})
    out = out.withColumns({x: joined(F.col(c), t) for x, c, t in zip(mids, high, tops)})
    out = out.withColumns({x: joined(F.col(c), m) for x, c, m in zip(numbers, low, mids)})
    return out.drop(*low, *sums, *high, *tops, *mids)


def holds(kind: str, match: Column) -> Column:
    """The check that a pattern's match must pass."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        digits = F.regexp_replace(match, "[ -]", "")
        return F.when(F.char_length(digits).between(12, 19),
                      F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(F.regexp_replace(match, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def with_base_spans(df: DataFrame) -> DataFrame:
    """Adds ``base``: all base spans of ``text``, by start, kind and end."""
    text, numbers = F.col("text"), [f"__at{i}" for i in range(len(KINDS))]
    tried = {i: text.rlike(GATES[kind]) for i, kind in enumerate(KINDS)}
    none = F.array().cast("array<string>")
    out = df.withColumns({f"__m{i}": F.when(tried[i], F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)))
                          .otherwise(none) for i, kind in enumerate(KINDS)})
    out = out.withColumns({f"__gap{i}": F.when(F.size(f"__m{i}") > 0, F.transform(
        F.split(text, PATTERNS[kind], -1), F.char_length)).otherwise(F.array().cast("array<int>"))
        for i, kind in enumerate(KINDS)})
    out = out.withColumns({f"__at{i}": held([f"__gap{i}"], lambda gap: F.transform(
        f"__m{i}", lambda m, k: F.get(gap, k) + F.char_length(m))) for i in range(len(KINDS))})
    out = scan(out, numbers, plus)

    def of_kind(i: int, kind: str) -> Column:
        placed = held([f"__at{i}", f"__gap{i}"], lambda at, gap: F.transform(f"__m{i}", lambda m, k: F.struct(
            (F.get(at, k) + F.get(gap, k)).alias("start"), m.alias("match"))))
        passed = F.filter(placed, lambda x: holds(kind, x["match"]))
        return F.transform(passed, lambda x: F.struct(x["start"], F.lit(i).alias("kind"), (
            x["start"] + F.char_length(x["match"])).alias("end"))).cast(SPAN)
    out = out.withColumn("base", F.sort_array(F.concat(*[of_kind(i, kind) for i, kind in enumerate(KINDS)])))
    return out.drop(*[f"__{x}{i}" for x in ("m", "gap", "at") for i in range(len(KINDS))])


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def shape(token: Column) -> Column:
    """Letters as ``a``, digit runs by rough length, the rest as it is."""
    s = F.regexp_replace(token, r"\p{L}+", "a")
    for pattern, mark in (("[0-9]{7,}", "L"), ("[0-9]{4,6}", "M"), ("[0-9]{1,3}", "S")):
        s = F.regexp_replace(s, pattern, mark)
    return s


def context(word: Column) -> Column:
    """A neighbouring word as a pattern sees it."""
    core = F.regexp_replace(word, r"^[^\p{L}\p{N}+@]+|[^\p{L}\p{N}]+$", "")
    return let(F.when(core.rlike("[0-9@]"), shape(core)).otherwise(lower_ascii(core)), lambda c: F.when(
        F.char_length(c) > CONTEXT, F.concat(F.lit("#"), F.sha2(c, 256))).otherwise(c))


def with_elements(df: DataFrame) -> DataFrame:
    """Replaces ``text`` and ``base`` by ``parts``, the identifier-like parts of
    the text: tokens of one base span are one part, and so are neighbouring
    tokens without letters and ``@`` that only blanks part (a spaced number).
    Each with the base span's kind (null: none), the texts around it and the
    tokens before and after."""
    def joined(p, x):
        plain = lambda t: ~t["match"].rlike(r"[\p{L}@]")
        spaced = (p["owner"].isNull() & x["owner"].isNull() & x["before"].rlike(r"^\x20+$")
                  & plain(p) & plain(x) & ~p["match"].rlike("[.,;:!?]$"))
        return F.coalesce(p["owner"] == x["owner"], spaced)

    def part(t, a, b):
        first, last = F.get(t, a), F.get(t, b)
        rest = F.transform(F.slice(t, a + 2, b - a), lambda x: F.concat(x["before"], x["match"]))
        return F.struct(
            first["start"].alias("start"), F.concat(first["match"], F.array_join(rest, "")).alias("match"),
            first["owner"]["kind"].alias("seed"), first["before"].alias("before"),
            last["after"].alias("after"), F.coalesce(F.get(t, a - 1)["match"], F.lit("")).alias("previous"),
            F.coalesce(F.get(t, b + 1)["match"], F.lit("")).alias("next"))

    text, t, fields = F.col("text"), F.col("__t"), ("start", "end", "match", "before", "after")
    out = steps(df, __m=F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    out = steps(out, __around=F.split(text, TOKEN, -1)).drop("text")
    out = steps(out, __at=held(["__around"], lambda around: F.transform(
        "__m", lambda m, i: F.char_length(F.get(around, i)) + F.char_length(m))),
                __ends=F.transform("base", lambda s: s["end"]))
    out = scan(out, ["__at"], plus)
    out = steps(out, __t=held(["__at", "__around"], lambda at, around: F.transform("__m", lambda m, i: F.struct(
        (F.get(at, i) + F.char_length(F.get(around, i))).alias("start"), m.alias("match"),
        F.get(around, i).alias("before"), F.get(around, i + 1).alias("after"))))).drop("__m", "__around")
    out = steps(out, __cores=F.transform(t, cored), __at=F.col("__ends"))
    out = scan(out, ["__at"], larger)
    # the first span that ends after a part's start: the spans' running latest
    # ends and the parts' starts are merged by one sort, and a part's place less
    # its number is how many ends come first
    latest = F.zip_with("__at", "__ends", lambda a, e: F.struct(F.greatest(a, e).alias("at"), F.lit(0).alias("part")))
    starts = F.transform("__cores", lambda c: F.struct(c["start"].alias("at"), F.lit(1).alias("part")))
    out = steps(out, __sorted=F.sort_array(F.concat(latest, starts)))
    out = steps(out, __sorted=F.filter(F.transform("__sorted", lambda m, k: F.struct(
        m["part"].alias("part"), k.alias("k"))), lambda m: m["part"] == 1))
    out = steps(out, __at=held(["base"], lambda base: F.transform("__sorted", lambda m, i: F.get(base, m["k"] - i))))
    out = steps(out, __t=held(["__at", "__cores"], lambda at, cores: F.transform(t, lambda x, i: F.struct(
        *[x[c].alias(c) for c in fields if c != "end"], F.when(
            F.get(at, i)["start"] < F.get(cores, i)["end"], F.get(at, i)).alias("owner")))))
    out = steps(out.drop("__cores", "__at", "__sorted", "__ends", "base"), __fresh=held(["__t"], lambda t: F.when(
        F.size(t) > 0, F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | ~joined(
            F.get(t, i - 1), F.get(t, i))))))
    return steps(out, parts=held(["__t", "__fresh"], lambda t, fresh: F.transform(fresh, lambda a, k: part(
        t, a, F.coalesce(F.get(fresh, k + 1), F.size(t)) - 1)))).drop("__t", "__fresh")


def cored(x: Column) -> Column:
    """(start, end) of a token without the punctuation around it."""
    start = x["start"] + F.char_length(F.regexp_extract(x["match"], LEAD, 0))
    return F.struct(start.alias("start"), (start + F.char_length(
        F.regexp_extract(x["match"], CORE, 0))).alias("end"))


def fitting(core: Column) -> Column:
    """Which kinds an identifier's shape is like, in their order."""
    digits = F.char_length(F.regexp_replace(core, "[^0-9]", ""))
    ip = core.rlike(r"^[0-9]+(?:\.[0-9]+){3}$|^[0-9A-Fa-f]*(?::[0-9A-Fa-f]*){2,}$")
    number = ~core.rlike(r"[\p{L}@]") & ~ip
    return F.array(F.contains(core, F.lit("@")), ip, number & digits.between(12, 19),
                   number & (digits <= 15))


def kind_of(fits: Column, counts: Column) -> Column:
    """The kind that the shape fits and, of those, that most known instances
    of the pattern have."""
    ranked = F.zip_with(fits, counts, lambda f, n: F.struct(f.alias("f"), n.alias("n")))
    order = F.transform(ranked, lambda x, k: F.struct(x["f"].alias("f"), x["n"].alias("n"), (-k).alias("k")))
    return -F.array_max(order)["k"]


def occurrences(scanned: DataFrame) -> DataFrame:
    """Parts of (d, th, text, base): their span, instance, patterns, the
    kind of the base span that they overlap (null: none) and fitting kinds."""
    first_word = f"^{SPACE_CLASS}*+({WORD_CLASS}++)"
    last = F.reverse(F.regexp_extract(F.reverse("x.before"), first_word, 1))
    first = F.regexp_extract("x.after", first_word, 1)
    tokens = (scanned.where(F.col("text").rlike("[0-9@]"))
              .transform(with_elements)
              # outer: a filter on the parts would be pushed into all the steps that make them
              .select("d", "th", F.explode_outer("parts").alias("x")))
    near = lambda word, other: F.when(word != "", word).otherwise(F.col(other))
    trimmed = tokens.select(
        "d", "th", "x.seed",
        (F.col("x.start") + F.char_length(F.regexp_extract("x.match", LEAD, 0))).alias("start"),
        F.regexp_extract("x.match", CORE, 0).alias("core"),
        near(last, "x.previous").alias("left"), near(first, "x.next").alias("right"))
    placed = trimmed.where(F.col("core") != "").withColumn(
        "end", F.col("start") + F.char_length("core"))
    before, after = F.concat(F.lit("<"), context(F.col("left"))), F.concat(F.lit(">"), context(F.col("right")))
    own = F.concat(F.lit(" "), F.sha2(shape(F.col("core")), 256))
    return placed.select(
        "d", "th", "start", "end", "seed", F.sha2("core", 256).alias("instance"),
        fitting(F.col("core")).alias("fits"),
        F.array(before, after, F.concat(before, own), F.concat(after, own)).alias("patterns")).distinct()


def confident_patterns(tokens: DataFrame) -> DataFrame:
    """(pattern, confidence, counts) of the confident patterns after all rounds;
    counts are of known instances by kind."""
    edges = (tokens.select("instance", "seed", "fits", F.explode("patterns").alias("pattern"))
             .groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n"),
                                                 F.max("seed").alias("seed"),
                                                 F.max("fits").alias("fits")))
    edges = written(edges, "pattern-edges")
    seeds = written(edges.groupBy("instance").agg(F.max("seed").alias("kind"))
                    .where(F.col("kind").isNotNull()).withColumn("score", F.lit(1.0)), "instances")
    known = seeds
    for i in range(ROUNDS):
        weighed = edges.drop("seed").join(known, "instance", "left")
        n = F.col("n")
        pattern = (weighed.groupBy("pattern").agg(
            (F.sum(n * F.coalesce("score", F.lit(0.0))) / (F.sum(n) + SMOOTHING)).alias("confidence"),
            F.count("kind").alias("support"),
            F.array(*[F.count_if(F.col("kind") == k) for k in range(len(KINDS))]).alias("counts"))
            .where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENT))
            .select("pattern", "confidence", "counts"))
        pattern = written(pattern, "patterns")
        if i + 1 < ROUNDS:
            accepted = (edges.join(pattern, "pattern").groupBy("instance")
                        .agg(F.max(F.struct("confidence", "counts")).alias("best"), F.max("fits").alias("fits"))
                        .join(seeds, "instance", "left_anti")
                        .select("instance", kind_of(F.col("fits"), F.col("best.counts")).alias("kind"), F.col("best.confidence").alias("score")))
            known = written(seeds.unionByName(accepted), "instances")
    return pattern


def discovered(tokens: DataFrame) -> DataFrame:
    """(d, th, more): the new spans of each text that has some."""
    patterns = confident_patterns(tokens)
    hit = (tokens.where(F.col("seed").isNull())
           .select("d", "th", "start", "end", "fits", F.explode("patterns").alias("pattern"))
           .join(patterns, "pattern"))
    return (hit.groupBy("d", "th", "start", "end", "fits")
            .agg(F.max(F.struct("confidence", "counts")).alias("best"))
            .withColumn("kind", kind_of(F.col("fits"), F.col("best.counts")))
            .groupBy("d", "th").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("more")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, th, doc_id, base, spans) per row; spans are base and discovered."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(*identity(id_col, text_col), F.col(id_col).alias("doc_id"),
                          text.alias("text")).transform(with_base_spans)
    tokens = written(occurrences(scanned.select("d", "th", "text", "base")), "tokens")
    more = discovered(tokens)
    return (scanned.drop("text").join(more, ["d", "th"], "left")
            .withColumn("spans", F.when(F.col("more").isNull(), F.col("base")).otherwise(
                F.sort_array(F.concat("base", F.col("more").cast(SPAN)))))
            .drop("more"))


def masked(text: Column, spans: Column, sofar: Column) -> Column:
    """The text with each span (of overlapping ones, their union) replaced by
    the kind of the first in angle brackets; ``sofar`` has for each span the
    latest end before it. Pieces are cut from the text at four bytes a code
    point, where an offset needs no search."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def cut(wide, begin, end):
        return F.decode(F.substring(wide, begin * 4 + 1, (end - begin) * 4), "UTF-32")

    def pieces(wide):
        fresh = F.filter(F.zip_with(spans, sofar, lambda s, e: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), e.alias("e"))), lambda x: x["start"] >= x["e"])
        shown = F.transform(fresh, lambda x: F.concat(cut(wide, x["e"], x["start"]), F.get(names, x["kind"])))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(shown, ""), cut(wide, last, F.char_length(text)))

    return let(F.encode(text, "UTF-32"), pieces)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, with the personal data of the texts masked."""
    spans = (find(docs, id_col, text_col).where(F.size("spans") > 0)
             .select("d", "th", F.col("spans").alias("__spans")).dropDuplicates(["d", "th"]))
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    text = F.col("__row")[text_col]
    new = F.when(F.col("__spans").isNull(), text).otherwise(
        masked(text, F.col("__spans"), F.col("__sofar")))
    paired = docs.select(row, *identity(id_col, text_col)).join(spans, ["d", "th"], "left")
    ends = F.transform(F.coalesce("__spans", F.array().cast(SPAN)), lambda s: s["end"])
    return (scan(paired.withColumn("__sofar", ends), ["__sofar"], larger)
            .select(*[(new if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns]))
