"""Search requests read into filters: budgets in everyday language, sizes, then colours, categories and brands of a lexicon.

A request keeps its number of words through every step: what a step understands is replaced by as many marks. So each step
sees only what is left, and what stays at the end is the text to search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.classify import phrase_hits
from quarry.plans.registry import Tables, query

#: Marks of an understood word, and of a "thousand" that went into the number before it.
TAKEN, JOINED = "\u0001", "\u0002"
# The band of "about", the largest amount, the least confidence for a category, the letters after a brand that count.
BAND, LARGEST, LEAST, AFTER = 0.2, 10000000, 0.35, 16
# Words of everyday requests, words that don't count, negations, comparisons.
FILLERS = ("arıyorum", "arayışındayım", "istiyorum", "bakıyorum", "lazım", "alacağım", "almak", "bana", "ben", "bir", "bi", "merhaba", "selam", "lütfen")
CONNECTORS = ("için", "icin", "uyumlu", "ucuz", "uygun", "fiyatlı", "fiyatli", "çok", "cok", "şey", "şeyler", "destekli")
EXCLUDING = ("olmasın", "olmasin", "hariç", "haric", "değil", "degil", "dışında", "disinda")
NEGATIONS = (*EXCLUDING, "olmayan", "olmadan")
COMPARING = ("tarzı", "tarzi", "gibi")

# An amount with an ending and a currency, and what makes it a bound. Java and RE2 read all of them alike.
_END = r"(?:'?\p{L}{0,4})?"
_MONEY = rf"(\d[\d.]*){_END}(?: {JOINED})?(?:\s*(?:tl|lira|₺){_END})?"
_WORD = r"\p{L}*"
BOUNDS = (
    ("between", rf"{_MONEY}\s+(?:ile|ve)\s+{_MONEY}\s*aras{_WORD}"),
    ("most", rf"(?:en fazla|en çok|maksimum|maks|max|azami)\s*{_MONEY}"),
    ("least", rf"(?:en az|minimum|asgari)\s*{_MONEY}"),
    ("most", rf"{_MONEY}\s+(?:geçme|aşma){_WORD}"),
    ("most", rf"{_MONEY}\s+kadar"),
    ("about", rf"(?:yaklaşık|takriben|ortalama|aşağı yukarı)\s*{_MONEY}"),
    ("about", rf"{_MONEY}\s+(?:civar|dolay){_WORD}"),
)
THOUSANDS = r"(^|[^\p{L}\p{N}.,])(\d{1,4})(?:[.,](\d))?\s*(?:-|–|ile|ve)\s*(\d{1,4})(?:[.,](\d))?\s?bin\p{L}{0,4}(?:\s*(?:tl|lira|₺)'?\p{L}{0,4})?(?:\s+aras\p{L}*)?( |$)"
NUMERIC = (
    ("between", r"(\d[\d.]*)\s*-\s*(\d[\d.]*)\s*(?:tl|₺|try)?\s*aras[ıi]"),
    ("most", r"(\d[\d.]*)\s*(?:tl|₺|try)?\s*alt(?:ı|ında)"),
    ("most", r"-(\d[\d.]*)\s*(?:tl|₺|try)"),
)


def normalized(text: Column) -> Column:
    """Lower case as Turkish has it, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(F.translate(text, "Iİ", "ıi")), r"\s+", " "))


def with_thousands(text: Column) -> Column:
    """"2,5 bin" is 2500 and "5 bin" 5000; the word that went into the number leaves a mark."""
    out = text
    for decimal, zeros in ((r"[.,](\d)", "00"), ("()", "000")):
        for gap, mark in ((" ", " " + JOINED), ("", "")):
            out = F.regexp_replace(out, rf"(^|[^\p{{L}}\p{{N}}.,])(\d{{1,4}}){decimal}{gap}bin(\p{{L}}{{0,4}})( |$)", f"$1$2$3{zeros}$4{mark}$5")
    return out


def whole(pattern: str) -> str:
    """A pattern that takes the whole words it touches."""
    return rf"[^ ]*?(?:{pattern})[^ ]*"


def marks(found: Column) -> Column:
    """As many marks as a found text has words, with the blank at its end if it has one."""
    n = F.size(F.split(F.trim(found), " +"))
    return F.concat(F.array_join(F.array_repeat(F.lit(TAKEN), n), " "), F.when(found.endswith(" "), " ").otherwise(""))


def amount(text: Column) -> Column:
    """A sensible amount, or null."""
    value = F.try_to_number(F.nullif(F.substring(F.replace(text, F.lit("."), F.lit("")), 1, 12), F.lit("")), F.lit("999999999999")).cast("long")
    return F.when((value > 0) & (value <= LARGEST), value)


def take_bounds(rows: DataFrame, kind: str, pattern: str) -> DataFrame:
    """`rows` with every sensible match of a bound taken from `rest`; the last one sets `low` and `high`."""
    wide = whole(pattern)
    group = lambda m, i: F.regexp_extract(m, pattern, i)
    sums = (lambda m: [amount(group(m, 1)), amount(group(m, 2))]) if kind == "between" else (lambda m: [amount(group(m, 1))])
    good = lambda m: F.forall(F.array(*sums(m)), lambda a: a.isNotNull())
    rows = rows.withColumn("_found", F.filter(F.regexp_extract_all("rest", F.lit(wide), F.lit(0)), good))
    rows = rows.withColumn("_last", F.get("_found", F.size("_found") - 1))
    a, b = (F.coalesce(amount(group(F.col("_last"), i)), F.lit(0)) for i in (1, 2)) if kind == "between" else (amount(group(F.col("_last"), 1)), None)
    round_up = lambda x: F.floor(x + 0.5).cast("long")
    low, high = {
        "between": lambda: (F.least(a, b), F.greatest(a, b)),
        "most": lambda: (None, a),
        "least": lambda: (a, None),
        "about": lambda: (round_up(a * (1 - BAND)), round_up(a * (1 + BAND))),
    }[kind]()
    some = F.size("_found") > 0
    changed = {"rest": F.aggregate("_found", F.col("rest"), lambda acc, m: F.replace(acc, m, marks(m)))}
    for name, bound in (("low", low), ("high", high)):
        if bound is not None:
            changed[name] = F.when(some, bound * 100).otherwise(F.col(name))
    return rows.withColumns(changed).drop("_found", "_last")


def take_thousand_ranges(rows: DataFrame) -> DataFrame:
    """"5-10 bin": the thousand counts for both ends; a first end above the second is no range."""
    number = lambda m, i: F.regexp_extract(m, THOUSANDS, i)
    thousand = lambda m, i: F.coalesce(F.try_to_number(number(m, i), F.lit("9999")).cast("long"), F.lit(0)) * 1000 + F.coalesce(F.try_to_number(F.nullif(number(m, i + 1), F.lit("")), F.lit("9")).cast("long"), F.lit(0)) * 100
    good = lambda m: (thousand(m, 2) > 0) & (thousand(m, 4) <= LARGEST) & (thousand(m, 2) <= thousand(m, 4))
    rows = rows.withColumn("_found", F.filter(F.regexp_extract_all("rest", F.lit(THOUSANDS), F.lit(0)), good))
    rows = rows.withColumn("_last", F.get("_found", F.size("_found") - 1))
    some = F.size("_found") > 0
    # The blank before a range is no part of its words.
    marked = lambda m: F.concat(F.when(m.startswith(" "), " ").otherwise(""), marks(F.ltrim(m)))
    return rows.withColumns(
        {
            "rest": F.aggregate("_found", F.col("rest"), lambda acc, m: F.replace(acc, m, marked(m))),
            "low": F.when(some, thousand(F.col("_last"), 2) * 100),
            "high": F.when(some, thousand(F.col("_last"), 4) * 100),
        }
    ).drop("_found", "_last")


def with_budget(rows: DataFrame) -> DataFrame:
    """`rows` (with text) and rest, low and high in hundredths: everyday bounds in order, then plain numeric ones."""
    rows = rows.withColumn("rest", normalized(F.coalesce("text", F.lit(""))))
    rows = take_thousand_ranges(rows)
    rows = rows.withColumn("rest", with_thousands(F.col("rest")))
    # "up to such a" is no bound: its word is hidden from the patterns.
    rows = rows.withColumn("rest", F.replace("rest", F.lit(" kadar bir"), F.lit(" k\u0003adar bir")))
    for kind, pattern in (*BOUNDS, *NUMERIC):
        rows = take_bounds(rows, kind, pattern)
    return settled(rows.withColumn("rest", F.replace("rest", F.lit("\u0003"), F.lit(""))))


def settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator: later filters are not pushed into long chains of columns, which would copy them."""
    return rows.select(F.explode(F.array(F.struct(*rows.columns))).alias("r")).select("r.*")


def requests(t: Tables) -> DataFrame:
    """A search request for every product, in one of twenty forms, with amounts from its price."""
    k = (F.col("catalog_price") / 100).cast("long")
    n, b = F.col("product_id"), F.lower("brand")
    forms = (
        F.concat_ws(" ", "title", k, F.lit("TL altı")),
        F.concat_ws(" ", F.lit("en fazla"), k, F.lit("lira"), "title", F.lit("arıyorum")),
        F.concat_ws(" ", "title", F.concat(k % 9 + 1, F.lit("-"), k % 9 + 3), F.lit("bin arası")),
        F.concat_ws(" ", "title", k % 40, F.lit("bine kadar"), b, F.lit("olmasın")),
        F.concat_ws(" ", "title", F.concat(k % 7, F.lit(",5")), F.lit("bin civarı")),
        F.concat_ws(" ", F.lit("yaklaşık"), k, F.lit("tl"), "title"),
        F.concat_ws(" ", k, F.lit("ile"), k + 500, F.lit("arası"), "title", b),
        F.concat_ws(" ", F.concat(k + 500, F.lit(" ve ")), k, F.lit("TL arasında"), "title"),
        F.concat_ws(" ", "title", k % 30 + 20, F.lit("numara en az"), k),
        F.concat_ws(" ", b, F.lit("tarzı"), "title", F.concat(k, F.lit("'i geçmesin"))),
        F.concat_ws(" ", "title", F.lit("XL beden"), F.concat(F.lit("-"), k, F.lit("₺"))),
        F.concat_ws(" ", "title", b, F.lit("hariç"), F.lit("plastik olmayan")),
        F.concat_ws(" ", F.lit("bana ucuz"), "title", F.lit("lazım")),
        F.concat_ws(" ", "title", k, F.lit("kadar bir şey")),
        F.concat_ws(" ", "title", F.lit("iphone 16"), F.lit("99000000 tl altında")),
        F.concat_ws(" ", "title", F.concat(k, F.lit("-"), k + 100), F.lit("tl arası")),
        F.concat_ws(" ", "title", F.lit("9-3 bin")),
        F.concat_ws(" ", F.lit("mavi"), "title", F.lit("kırmızı değil")),
        F.concat_ws(" ", "title", k % 9, F.lit("bin lirayı aşmasın en az"), k),
        F.col("title"),
    )
    text = forms[-1]
    for i, form in enumerate(forms[:-1]):
        text = F.when(n % 20 == i, form).otherwise(text)
    return t.products.select(n.alias("query_id"), text.alias("text"))


def lexicon_of(t: Tables) -> DataFrame:
    """value (kind, name and weight joined by |), tokens and n: colours, categories and brands of the catalog."""
    words = t.products.select(F.split("title", " ").alias("w"), F.split("path", "/").alias("p"), F.col("brand"))
    color = words.select(F.concat(F.lit("color|"), F.col("w")[0], F.lit("|1")).alias("value"), F.array(F.col("w")[0]).alias("tokens"))
    category = words.select(F.concat(F.lit("category|"), F.col("w")[1], F.lit("|2")).alias("value"), F.array(F.col("w")[1]).alias("tokens"))
    both = words.where(F.col("p")[0] == "promo").select(F.concat(F.lit("category|promo/"), F.col("w")[0], F.lit("-"), F.col("w")[1], F.lit("|3")).alias("value"), F.col("w").alias("tokens"))
    brand = words.select(F.concat(F.lit("brand|"), F.lower("brand"), F.lit("|1")).alias("value"), F.array(F.lower("brand")).alias("tokens"))
    turkish = t.spark.createDataFrame([("color|blue|1", ["mavi"]), ("color|red|1", ["kırmızı"])], "value string, tokens array<string>")
    return color.union(category).union(both).union(brand).union(turkish).distinct().withColumn("n", F.size("tokens"))


def parsed(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Filters, unparsed words and confidence of requests (query_id, text).

    Order: budget, one size, lexicon (longest first; a brand is left where it is only compared with, and excluded where a
    negation follows), fillers, negated words, connecting words (which don't count). Confidence is the share of understood
    words; a category needs enough of it.
    """
    rows = with_budget(rows.select("query_id", "text"))
    for pattern in (r"(\d+)\s*numara", r"(\p{L}+)\s*beden"):
        found = F.regexp_extract("rest", whole(pattern), 0)
        size = F.regexp_extract("rest", pattern, 1)
        known = F.col("size") if "size" in rows.columns else F.lit(None).cast("string")
        free = known.isNull() & (found != "")
        place = F.position(found, F.col("rest"))
        once = F.concat(F.substr("rest", F.lit(1), place - 1), marks(found), F.substr("rest", place + F.length(found)))
        rows = rows.withColumns({"size": F.when(free, F.upper(size)).otherwise(known), "rest": F.when(free, once).otherwise(F.col("rest"))})
    rows = settled(rows.withColumns({"tokens": F.split(normalized(F.coalesce("text", F.lit(""))), " "), "words": F.split("rest", " ")}))
    hits = phrase_hits(rows, lexicon, ("query_id",)).join(rows.select("query_id", "tokens"), "query_id")
    length = F.length(F.array_join(F.slice("tokens", F.col("start") + 1, F.col("n")), " "))
    tail = F.slice("tokens", F.col("start") + F.col("n") + 1, F.greatest(F.size("tokens"), F.lit(1)))
    after = F.substring(F.concat(F.lit(" "), F.array_join(tail, " ")), 1, AFTER)
    marker = F.filter(F.array(*map(F.lit, EXCLUDING)), lambda m: F.contains(F.col("after"), m))
    hits = hits.withColumns({"after": after, "length": length}).withColumn("marker", F.get(marker, F.lit(0)))
    before = F.substr("after", F.lit(1), F.position(F.col("marker"), F.col("after")))
    blanks = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
    one = F.struct(
        (-F.col("length")).alias("minus"), "start", "n", "value",
        F.forall(F.array(*map(F.lit, COMPARING)), lambda m: ~F.contains(F.col("after"), m)).alias("plain"),
        F.when(F.col("marker").isNotNull(), F.col("start") + F.col("n") + blanks - 1).alias("marked"),
    )
    hits = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("hits"))
    strings = F.array().cast("array<string>")

    def step(acc: Column, h: Column) -> Column:
        kind = F.split_part(h["value"], F.lit("|"), F.lit(1))
        span = F.sequence(h["start"], h["start"] + h["n"] - 1)
        taken = ~F.arrays_overlap(acc["used"], span) & ((kind != "brand") | h["plain"])
        marked = F.when((kind == "brand") & h["marked"].isNotNull(), F.array(h["marked"])).otherwise(F.array().cast("array<int>"))
        return F.struct(
            F.when(taken, F.concat(acc["used"], span, marked)).otherwise(acc["used"]).alias("used"),
            F.when(taken, F.array_append(acc["got"], F.when((kind == "brand") & h["marked"].isNotNull(), F.concat(F.lit("not"), h["value"])).otherwise(h["value"]))).otherwise(acc["got"]).alias("got"),
        )

    start = F.struct(F.array().cast("array<int>").alias("used"), strings.alias("got"))
    rows = rows.join(hits, "query_id", "left").withColumn("acc", F.when(F.col("hits").isNotNull(), F.aggregate("hits", start, step)).otherwise(start))
    plain = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]+", "")
    is_in = lambda w, words: plain(w).isin(*words)
    used = lambda i: F.get("words", i).isin(TAKEN) | F.array_contains("acc.used", i)
    rows = rows.withColumn("known", F.transform("tokens", lambda w, i: (used(i) | is_in(w, FILLERS)) & (w != "")))
    rows = rows.withColumn("negates", F.transform("tokens", lambda w, i: ~F.get("known", i) & is_in(w, NEGATIONS)))
    rows = rows.withColumn("known", F.transform("known", lambda k, i: k | F.get("negates", i) | F.coalesce(F.get("negates", i + 1), F.lit(False))))
    rows = rows.withColumn("ignored", F.transform("tokens", lambda w, i: ~F.get("known", i) & is_in(w, CONNECTORS)))
    count = lambda c: F.size(F.filter(c, lambda x: x))
    counted = F.when(F.col("tokens")[0] == "", 0).otherwise(F.size("tokens") - count("ignored"))
    rows = rows.withColumn("confidence", F.round(F.when(counted > 0, count("known") / counted).otherwise(0.0), 6))
    names = lambda kind: F.transform(F.filter("acc.got", lambda g: F.split_part(g, F.lit("|"), F.lit(1)) == kind), lambda g: F.split_part(g, F.lit("|"), F.lit(2)))
    joined = lambda kind: F.nullif(F.array_join(F.array_sort(F.array_distinct(names(kind))), ","), F.lit(""))
    weighed = F.transform(
        F.filter("acc.got", lambda g: g.startswith("category|")),
        lambda g, i: F.struct((-F.split_part(g, F.lit("|"), F.lit(3)).cast("int")).alias("minus"), i.alias("i"), F.split_part(g, F.lit("|"), F.lit(2)).alias("name")),
    )
    unparsed = F.filter("tokens", lambda w, i: ~F.get("known", i) & ~F.get("ignored", i))
    return rows.select(
        "query_id",
        F.col("low").alias("price_min"),
        F.col("high").alias("price_max"),
        "size",
        joined("color").alias("colors"),
        F.when(F.col("confidence") >= LEAST, F.array_min(weighed)["name"]).alias("category"),
        joined("brand").alias("brand_include"),
        joined("notbrand").alias("brand_exclude"),
        F.array_join(unparsed, " ").alias("unparsed"),
        "confidence",
    )


# SQL: the same steps, one table a step.

_FORMS_SQL = """forms AS (SELECT query_id, CASE query_id % 20 WHEN 0 THEN title || ' ' || k || ' TL altı' WHEN 1 THEN 'en fazla ' || k || ' lira ' || title || ' arıyorum'
  WHEN 2 THEN title || ' ' || (k % 9 + 1) || '-' || (k % 9 + 3) || ' bin arası' WHEN 3 THEN title || ' ' || (k % 40) || ' bine kadar ' || b || ' olmasın'
  WHEN 4 THEN title || ' ' || (k % 7) || ',5 bin civarı' WHEN 5 THEN 'yaklaşık ' || k || ' tl ' || title WHEN 6 THEN k || ' ile ' || (k + 500) || ' arası ' || title || ' ' || b
  WHEN 7 THEN (k + 500) || ' ve  ' || k || ' TL arasında ' || title WHEN 8 THEN title || ' ' || (k % 30 + 20) || ' numara en az ' || k
  WHEN 9 THEN b || ' tarzı ' || title || ' ' || k || '''i geçmesin'  WHEN 10 THEN title || ' XL beden -' || k || '₺' WHEN 11 THEN title || ' ' || b || ' hariç plastik olmayan'
  WHEN 12 THEN 'bana ucuz ' || title || ' lazım' WHEN 13 THEN title || ' ' || k || ' kadar bir şey' WHEN 14 THEN title || ' iphone 16 99000000 tl altında'
  WHEN 15 THEN title || ' ' || k || '-' || (k + 100) || ' tl arası' WHEN 16 THEN title || ' 9-3 bin' WHEN 17 THEN 'mavi ' || title || ' kırmızı değil'
  WHEN 18 THEN title || ' ' || (k % 9) || ' bin lirayı aşmasın en az ' || k ELSE title END AS text
  FROM (SELECT product_id AS query_id, catalog_price // 100 AS k, lower(brand) AS b, title FROM products))"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _marks_sql(m: str) -> str:
    return f"rtrim(repeat('{TAKEN} ', len(regexp_split_to_array(trim({m}), ' +')))) || CASE WHEN ends_with({m}, ' ') THEN ' ' ELSE '' END"


def _amount_sql(m: str, pattern: str, i: int) -> str:
    return f"TRY_CAST(left(replace(regexp_extract({m}, {_quoted(pattern)}, {i}), '.', ''), 12) AS BIGINT)"


def budget_sql() -> str:
    """CTEs from `forms` (query_id, text) to `budget` (query_id, text, rest, low, high)."""
    thousand = lambda m, i: f"(TRY_CAST(regexp_extract({m}, {_quoted(THOUSANDS)}, {i}) AS BIGINT) * 1000 + coalesce(TRY_CAST(regexp_extract({m}, {_quoted(THOUSANDS)}, {i + 1}) AS BIGINT), 0) * 100)"
    good = f"{thousand('m', 2)} > 0 AND {thousand('m', 4)} <= {LARGEST} AND {thousand('m', 2)} <= {thousand('m', 4)}"
    steps = [
        r"b0 AS (SELECT query_id, text, trim(regexp_replace(lower(translate(coalesce(text, ''), 'Iİ', 'ıi')), '\s+', ' ', 'g')) AS rest FROM forms)",
        f"b1 AS (SELECT *, list_filter(regexp_extract_all(rest, {_quoted(THOUSANDS)}), lambda m: {good}) AS found FROM b0)",
        f"b2 AS (SELECT query_id, text, list_reduce(found, lambda acc, m: replace(acc, m, CASE WHEN starts_with(m, ' ') THEN ' ' ELSE '' END || {_marks_sql('ltrim(m)')}), rest) AS rest, "
        f"{thousand('found[-1]', 2)} * 100 AS low, {thousand('found[-1]', 4)} * 100 AS high FROM b1)",
    ]
    text = "rest"
    for decimal, zeros in ((r"[.,](\d)", "00"), ("()", "000")):
        for gap, mark in ((" ", " " + JOINED), ("", "")):
            text = rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{N}}.,])(\d{{1,4}}){decimal}{gap}bin(\p{{L}}{{0,4}})( |$)', '\1\2\3{zeros}\4{mark}\5', 'g')"
    steps.append(f"b3 AS (SELECT * REPLACE (replace({text}, ' kadar bir', ' k\u0003adar bir') AS rest) FROM b2)")
    last = "b3"
    for i, (kind, pattern) in enumerate((*BOUNDS, *NUMERIC)):
        group = lambda m, g, p=pattern: _amount_sql(m, p, g)
        wanted = (1, 2) if kind == "between" else (1,)
        valid = " AND ".join(f"coalesce({group('m', g)} BETWEEN 1 AND {LARGEST}, false)" for g in wanted)
        a, b = group("found[-1]", 1), group("found[-1]", 2)
        low, high = {
            "between": (f"least({a}, {b})", f"greatest({a}, {b})"),
            "most": (None, a),
            "least": (a, None),
            "about": (f"floor({a} * (1 - {BAND}::DOUBLE) + 0.5)::BIGINT", f"floor({a} * (1 + {BAND}::DOUBLE) + 0.5)::BIGINT"),
        }[kind]
        bound = lambda name, x: f", CASE WHEN len(found) > 0 THEN {x} * 100 ELSE {name} END AS {name}" if x else f", {name}"
        steps.append(f"f{i} AS (SELECT *, list_filter(regexp_extract_all(rest, {_quoted(whole(pattern))}), lambda m: {valid}) AS found FROM {last})")
        steps.append(f"g{i} AS (SELECT query_id, text, list_reduce(found, lambda acc, m: replace(acc, m, {_marks_sql('m')}), rest) AS rest{bound('low', low)}{bound('high', high)} FROM f{i})")
        last = f"g{i}"
    steps.append(f"budget AS (SELECT * REPLACE (replace(rest, '\u0003', '') AS rest) FROM {last})")
    return ",\n".join(steps)


@query(
    "q_price_language",
    f"""WITH {_FORMS_SQL}, {budget_sql()}
SELECT query_id, low AS price_min, high AS price_max, array_to_string(list_filter(string_split(rest, ' '), lambda w: w NOT IN ('{TAKEN}', '{JOINED}')), ' ') AS rest FROM budget""",
)
def q_price_language(t: Tables) -> DataFrame:
    """The budget that every request states, and the words that are left."""
    left = F.array_join(F.filter(F.split("rest", " "), lambda w: ~w.isin(TAKEN, JOINED)), " ")
    return with_budget(requests(t)).select("query_id", F.col("low").alias("price_min"), F.col("high").alias("price_max"), left.alias("rest"))


@query("q_parse")
def q_parse(t: Tables) -> DataFrame:
    """Every request as filters and a text to search."""
    return parsed(requests(t), lexicon_of(t))
