"""Normalisation of descriptions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning in a history key (fixed values).
HISTORY_NOISE = "the a an and or for with in on of to by at per from is are was no not".split()
#: Words that carry no meaning in an assessed key (fixed values).
ASSESSED_NOISE = (
    "the a an and or for with in on to of no nr num pcs pc ea each qty quantity size color colour pack set pieces item items "
    "new used unit units assorted various other"
).split()
#: Words left out of search terms (fixed values).
SEARCH_NOISE = "the a an and or for with in on to of size color pack set pcs pieces item new".split()
#: Descriptions too general to be a key (fixed values).
GENERIC = (
    "parts", "accessories", "other", "parts accessories", "miscellaneous", "misc", "sundry", "sundries", "goods", "general cargo", "articles", "samples",
    "sample", "spare parts", "spares", "components", "supplies", "hardware", "materials", "items", "products",
)
#: Materials, products and buyers looked for, in this order (fixed values).
MATERIALS = "cotton polyester leather plastic metal steel stainless wood glass rubber silicone nylon".split()
PRODUCTS = (
    "pants shirt dress shoes bag bottle phone case charger cable toy game watch jewelry headphone earphone makeup cream lotion"
).split()
DEMOGRAPHICS = "kids children baby men women adult toddler".split()


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _meaningful(text: Column, noise: list[str]) -> Column:
    """The words of ``text``, one space between them, without single characters and noise in any case.

    By one expression with lookaround: faster than a lambda on each word.
    """
    dropped = F.regexp_replace(text, r"(?i)(?<!\S)(?:\S|" + "|".join(noise) + r")(?!\S)", "")
    return F.trim(F.regexp_replace(dropped, r"\s+", " "))


def history_key(text: Column) -> Column:
    """Lower case, punctuation to spaces, standalone numbers, noise and single letters dropped. Null gives an empty key."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"(?U)[^\w\s]", " ")
    return _meaningful(F.regexp_replace(bare, r"(?U)\b\d+\b", ""), HISTORY_NOISE)


def assessed_key(text: Column) -> Column:
    """Lower case, only ASCII letters and digits; noise and single characters dropped; numbers stay."""
    return _meaningful(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9\\s]", " "), ASSESSED_NOISE)


#: Precomposed Latin letters and what they are without accents; folding leaves other characters to the key's own filter.
_ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def folded(text: Column) -> Column:
    """Latin letters without their accents."""
    return F.translate(F.regexp_replace(text, "[\\u0300-\\u036f]", ""), _ACCENTED, _PLAIN)


def extract_key(text: Column) -> Column:
    """The assessed key after accents are folded."""
    return assessed_key(folded(text))


def rule_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def search_terms(text: Column, most: int = 5) -> Column:
    """The first ``most`` meaningful words, in their own case."""
    return F.substring_index(_meaningful(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[^\w\s]", " "), SEARCH_NOISE), " ", most)


def _first_of(text: Column, values: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(text, F.lit(v)), F.lit(v)) for v in values])


def simplified(text: Column) -> Column:
    """Buyer, material and product, the first of each that the text contains; search terms if it has none."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    found = F.concat_ws(" ", _first_of(lower, DEMOGRAPHICS), _first_of(lower, MATERIALS), _first_of(lower, PRODUCTS))
    return F.when(found == "", search_terms(text)).otherwise(found)


def product_type(text: Column) -> Column:
    """A similarity key: sizes, units, colours and numbers dropped."""
    out = F.upper(F.coalesce(text, F.lit("")))
    for pattern in (r"\b\d+([./]\d+)?\s*(MM|CM|M|IN|FT|OZ|LB|LBS|KG|G|ML|L|PC|PCS|PK|CT)\b", r"\bSIZE\s+\w+", r"\b(BLACK|WHITE|RED|BLUE|GREEN|YELLOW|GREY|GRAY|BROWN|PINK|PURPLE|ORANGE)\b", r"\d+", r"[^A-Z ]", r"\s+"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def specific_enough(key: Column) -> Column:
    """Whether a key is specific: four characters, not a number, not general, two words or one of six characters."""
    count = F.size(words(key))
    return (F.length(key) >= 4) & ~F.replace(key, F.lit(" "), F.lit("")).rlike("^[0-9]+$") & ~key.isin(*GENERIC) & ((count >= 2) | (F.length(key) >= 6))


def cleaned_label(text: Column, most: int = 80) -> Column:
    """A category label: white space collapsed, leading marks dropped, cut at the first qualifier, at most ``most`` characters."""
    one = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.substring_index(F.substring_index(F.substring_index(F.regexp_replace(one, "^[-–: ]+", ""), " - ", 1), "; ", 1), " (see ", 1)
    return F.trim(F.when(F.length(cut) > most, F.substring(cut, 1, most)).otherwise(cut))
