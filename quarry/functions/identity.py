"""Trade item numbers, part numbers and variant options as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.registry import Tables, query

# Codes that merchants write where they have none.
ASCENDING, DESCENDING = "01234567890123456789", "98765432109876543210"
MPN_PLACEHOLDERS = (
    "yok", "na", "nan", "none", "null", "nil", "unknown", "bilinmiyor", "belirtilmemis", "standart", "standard",
    "tek", "tekurun", "default", "test", "sku", "mpn", "model",
)
MPN_LEAST = 4
# Prefixes of 13 digits that circulate inside a shop or name books, coupons and refunds.
RESTRICTED_13 = r"^(0[245]|2[0-9][0-9]|97[7-9]|98[0-4]|99[0-9])"
# A source's axis name and ours.
AXIS_ALIASES = {
    "beden": "beden", "size": "beden", "numara": "beden", "olcu": "beden", "renk": "renk", "color": "renk",
    "colour": "renk", "kapasite": "kapasite", "capacity": "kapasite", "storage": "kapasite", "hafiza": "kapasite",
    "depolama": "kapasite", "hacim": "hacim", "volume": "hacim", "agirlik": "agirlik", "weight": "agirlik",
    "adet": "adet", "quantity": "adet", "paket": "adet",
}
UNIT_AFTER_BLANK = r"(\d)\s+(gb|tb|mb|ml|l|lt|g|gr|kg|cm|mm|adet)\b"


def _accented() -> tuple[str, str]:
    """Latin letters that decompose to one letter and marks, and those letters."""
    pairs = []
    for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accented()


def strip_accents(text: Column) -> Column:
    """Both Turkish i's and I become i, other Latin letters lose their marks."""
    return F.translate(F.translate(text, "İIı", "iii"), _FROM, _TO)


def strip_accents_sql(x: str) -> str:
    return f"strip_accents(translate({x}, 'İIı', 'iii'))"


def folded(text: Column) -> Column:
    """ASCII words in lower case, one blank between."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", " "))


def singular(word: Column) -> Column:
    """A folded word without a plural s (glass and dress keep theirs)."""
    plural = (F.length(word) > 3) & word.endswith("s") & ~word.endswith("ss")
    return F.when(plural, F.substr(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def fold_words(text: Column) -> Column:
    """The folded words of a text, in the singular."""
    return F.transform(F.filter(F.split(folded(text), " "), lambda w: w != ""), singular)


def singular_sql(w: str) -> str:
    return f"CASE WHEN len({w}) > 3 AND right({w}, 1) = 's' AND right({w}, 2) <> 'ss' THEN left({w}, len({w}) - 1) ELSE {w} END"


def fold_words_sql(x: str) -> str:
    return f"list_transform(list_filter(string_split({folded_sql(x)}, ' '), lambda w: w <> ''), lambda w: {singular_sql('w')})"


def folded_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({strip_accents_sql(x)}), '[^a-z0-9]+', ' ', 'g'))"


def gtin_checks(code: Column) -> Column:
    """Whether a code of 8, 12, 13 or 14 digits ends with its check digit (weights 3 and 1 from the right)."""
    digits = F.reverse(F.transform(F.split(F.when(code.rlike("^[0-9]+$"), code).otherwise("0"), ""), lambda d: d.cast("int")))
    weighted = F.transform(F.filter(digits, lambda d: d.isNotNull()), lambda d, i: F.when(i == 0, 0).when(i % 2 == 1, 3 * d).otherwise(d))
    total = F.aggregate(weighted, F.lit(0), lambda a, d: a + d)
    shape = code.rlike(r"^([0-9]{8}|[0-9]{12,14})$")
    return shape & ((10 - total % 10) % 10 == F.substring(code, -1, 1).cast("int"))


def gtin_checks_sql(c: str) -> str:
    total = f"list_sum(list_transform(range(1, len({c})), lambda i: TRY_CAST(substr({c}, len({c}) - i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))"
    return f"(regexp_full_match({c}, '[0-9]{{8}}|[0-9]{{12,14}}') AND (10 - {total} % 10) % 10 = TRY_CAST(right({c}, 1) AS INT))"


def clean_gtin(raw: Column) -> Column:
    """The code without blanks around it; null for wrong check digits, one repeated digit and counting sequences."""
    code = F.trim(raw)
    bare = F.regexp_replace(code, "^0+", "")
    uniform = code.rlike(r"^([0-9])\1*[0-9]$")
    counting = F.lit(ASCENDING).contains(bare) | F.lit(DESCENDING).contains(bare)
    return F.when(gtin_checks(code) & (bare != "") & ~uniform & ~counting, code)


def clean_gtin_sql(x: str) -> str:
    c = f"trim({x})"
    bare = f"regexp_replace({c}, '^0+', '')"
    uniform = f"len(list_distinct(string_split(left({c}, len({c}) - 1), ''))) = 1"
    return (
        f"CASE WHEN {gtin_checks_sql(c)} AND {bare} <> '' AND NOT ({uniform}) "
        f"AND NOT contains('{ASCENDING}', {bare}) AND NOT contains('{DESCENDING}', {bare}) THEN {c} END"
    )


def gtin_status(clean: Column) -> Column:
    """valid, restricted or invalid, for a cleaned code."""
    wide = F.lpad(clean, 14, "0")
    return (
        F.when(clean.isNull(), "invalid")
        .when(F.length(clean) == 8, F.when(clean.rlike("^[02]"), "restricted").otherwise("valid"))
        .when(wide.startswith("9") | F.substring(wide, 2, 13).rlike(RESTRICTED_13), "restricted")
        .otherwise("valid")
    )


def gtin_status_sql(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NULL THEN 'invalid' WHEN len({c}) = 8 THEN CASE WHEN left({c}, 1) IN ('0', '2') THEN 'restricted' ELSE 'valid' END "
        f"WHEN left(lpad({c}, 14, '0'), 1) = '9' OR regexp_matches(substr(lpad({c}, 14, '0'), 2), '{RESTRICTED_13}') THEN 'restricted' ELSE 'valid' END"
    )


def gtin14(raw: Column) -> Column:
    """A valid code padded to 14 digits, else null."""
    clean = clean_gtin(raw)
    return F.when(gtin_status(clean) == "valid", F.lpad(clean, 14, "0"))


def clean_mpn(raw: Column) -> Column:
    """The part number unchanged; null for placeholders, short codes and one repeated character."""
    bare = F.regexp_replace(F.lower(F.trim(raw)), "[^a-z0-9]", "")
    bad = (F.length(bare) < MPN_LEAST) | bare.isin(*MPN_PLACEHOLDERS) | bare.rlike(r"^(.)\1*$")
    return F.when(~bad, F.trim(raw))


def mpn_norm(raw: Column) -> Column:
    """A cleaned part number to compare by: upper case, no separators."""
    return F.nullif(F.upper(F.regexp_replace(strip_accents(clean_mpn(raw)), r"[\s\-._/]", "")), F.lit(""))


def mpn_norm_sql(x: str) -> str:
    bare = f"regexp_replace(lower(trim({x})), '[^a-z0-9]', '', 'g')"
    names = ", ".join(f"'{p}'" for p in MPN_PLACEHOLDERS)
    clean = f"CASE WHEN len({bare}) >= {MPN_LEAST} AND {bare} NOT IN ({names}) AND len(list_distinct(string_split({bare}, ''))) > 1 THEN trim({x}) END"
    return rf"nullif(upper(regexp_replace({strip_accents_sql(clean)}, '[\s\-._/]', '', 'g')), '')"


def axis_name(name: Column) -> Column:
    key = F.trim(F.regexp_replace(F.lower(strip_accents(name)), "[^a-z0-9]+", "_"), F.lit("_"))
    ours = reduce(lambda e, kv: F.when(key == kv[0], kv[1]).otherwise(e), AXIS_ALIASES.items(), key)
    return F.nullif(ours, F.lit(""))


def axis_value(value: Column) -> Column:
    text = F.regexp_replace(F.trim(F.lower(strip_accents(value))), r"\s+", " ")
    text = F.regexp_replace(text, UNIT_AFTER_BLANK, "$1$2")
    return F.nullif(F.trim(F.translate(text, ";=", ",-")), F.lit(""))


def option_key(*options: tuple[Column, Column]) -> Column:
    """Normalised `axis=value` pairs in axis order; pairs without a name or value are left out."""
    pairs = [F.struct(axis_name(n).alias("axis"), axis_value(v).alias("value")) for n, v in options]
    known = F.filter(F.array(*pairs), lambda e: e["axis"].isNotNull() & e["value"].isNotNull())
    return F.array_join(F.transform(F.array_sort(known), lambda e: F.concat_ws("=", e["axis"], e["value"])), ";")


@query("str_strip_accents", f"SELECT doc_id, md5({strip_accents_sql('text')}) AS plain FROM documents")
def str_strip_accents(t: Tables) -> DataFrame:
    """Whole texts without the marks of Latin letters; letters of other scripts stay as they are."""
    return t.documents.select("doc_id", F.md5(strip_accents(F.col("text"))).alias("plain"))


@query("str_fold_words", f"SELECT doc_id, md5(array_to_string(list_transform(string_split({folded_sql('text')}, ' '), lambda w: CASE WHEN len(w) > 3 AND right(w, 1) = 's' AND right(w, 2) <> 'ss' THEN left(w, len(w) - 1) ELSE w END), ' ')) AS words FROM documents")
def str_fold_words(t: Tables) -> DataFrame:
    """ASCII words without a plural s (glass and dress keep theirs)."""
    words = F.array_join(F.transform(F.split(folded(F.col("text")), " "), singular), " ")
    return t.documents.select("doc_id", F.md5(words).alias("words"))


@query("str_path_norm", f"SELECT DISTINCT p_type, left(array_to_string(list_filter(list_transform(regexp_split_to_array(p, '\\s*(>|/|\\|)\\s*'), lambda x: {folded_sql('x')}), lambda x: x <> ''), ' > '), 500) AS path FROM (SELECT p_type, replace(p_type, ' ', CASE WHEN p_size % 3 = 0 THEN ' > ' WHEN p_size % 3 = 1 THEN '/' ELSE ' | ' END) || '//' || p_brand AS p FROM part)")
def str_path_norm(t: Tables) -> DataFrame:
    """Category paths written with >, / or |: parts folded, empty ones dropped, at most 500 characters."""
    mark = F.when(F.col("p_size") % 3 == 0, " > ").when(F.col("p_size") % 3 == 1, "/").otherwise(" | ")
    raw = F.concat(F.replace("p_type", F.lit(" "), mark), F.lit("//"), F.col("p_brand"))
    return t.part.select("p_type", path_norm(raw).alias("path")).distinct()


def path_norm(raw: Column) -> Column:
    parts = F.transform(F.split(raw, r"\s*(?:>|/|\|)\s*"), folded)
    return F.substring(F.array_join(F.filter(parts, lambda x: x != ""), " > "), 1, 500)


@query("id_gtin_clean", f"SELECT listing_id, {clean_gtin_sql('gtin')} AS code FROM listings")
def id_gtin_clean(t: Tables) -> DataFrame:
    return t.listings.select("listing_id", clean_gtin(F.col("gtin")).alias("code"))


@query(
    "id_gtin_classify",
    f"""SELECT listing_id, {gtin_status_sql('c')} AS status, CASE WHEN {gtin_status_sql('c')} = 'valid' THEN lpad(c, 14, '0') END AS gtin14,
    CASE WHEN {gtin_status_sql('c')} = 'valid' THEN len(c) > 8 AND left(lpad(c, 14, '0'), 1) <> '0' END AS package_level
    FROM (SELECT listing_id, {clean_gtin_sql('gtin')} AS c FROM listings)""",
)
def id_gtin_classify(t: Tables) -> DataFrame:
    """Status, the code at 14 digits, and whether it names a package rather than an item."""
    rows = t.listings.select("listing_id", clean_gtin(F.col("gtin")).alias("c"))
    status, wide = gtin_status(F.col("c")), F.lpad("c", 14, "0")
    valid = status == "valid"
    return rows.select(
        "listing_id", status.alias("status"), F.when(valid, wide).alias("gtin14"),
        F.when(valid, (F.length("c") > 8) & ~wide.startswith("0")).alias("package_level"),
    )


@query("id_mpn", f"SELECT listing_id, {mpn_norm_sql('mpn')} AS mpn FROM listings")
def id_mpn(t: Tables) -> DataFrame:
    return t.listings.select("listing_id", mpn_norm(F.col("mpn")).alias("mpn"))


@query(
    "id_option_key",
    f"""SELECT product_id, 'agirlik=' || replace(regexp_extract(v, '.*'), ' kg', 'kg') || ';beden=' || lower(size_text) || ';renk=' || lower(color) || ';x_kod=a-b,c' AS option_key
    FROM (SELECT product_id, size || ' kg' AS v, 'no ' || size AS size_text, split_part(title, ' ', 1) AS color FROM products)""",
)
def id_option_key(t: Tables) -> DataFrame:
    """Options under aliased axis names, in axis order; an option without a value is left out."""
    size = F.col("size").cast("string")
    key = option_key(
        (F.lit("Colour"), F.initcap(F.split_part("title", F.lit(" "), F.lit(1)))), (F.lit("SIZE"), F.concat(F.lit("No  "), size)),
        (F.lit("Weight"), F.concat(size, F.lit("  KG"))), (F.lit("X Kod"), F.lit("a=b;c")), (F.lit("paket"), F.lit(None).cast("string")),
    )
    return t.products.select("product_id", key.alias("option_key"))
