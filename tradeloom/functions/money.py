"""Amounts: parsing, repair of recognised numbers, conversion and duties, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(18,4)"


def currency(text: Column) -> Column:
    """``$1,234.56`` as a decimal; ``(x)`` and ``-x`` are negative; anything else, null and blank included, is 0."""
    s = F.trim(F.coalesce(text, F.lit("")))
    brackets = s.rlike(r"^\(.*\)$")
    body = F.when(brackets, F.substr(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0)))).when(s.startswith("-"), F.substr(s, F.lit(2))).otherwise(s)
    bare = F.regexp_replace(body, "[$ €£¥,]", "")
    value = F.coalesce(F.when(bare.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)$"), bare.try_cast(AMOUNT)), F.lit(0).cast(AMOUNT))
    return F.when(brackets | s.startswith("-"), -value).otherwise(value)


def number(text: Column) -> Column:
    """Digits without currency signs, commas and spaces; 0 if that is no number."""
    return F.coalesce(F.regexp_replace(F.coalesce(text, F.lit("")), "[$, ]", "").try_cast("double"), F.lit(0.0))


def spaced_price(text: Column) -> Column:
    """``$39 99`` is 39.99; what is no number is 0."""
    return F.coalesce(F.regexp_replace(F.trim(F.regexp_replace(text, "[$,]", "")), r"^(\d+)\s+(\d{2})$", "$1.$2").try_cast(AMOUNT), F.lit(0).cast(AMOUNT))


def decimal_separators(token: Column) -> Column:
    """Which of space, comma and middle dot is the decimal point: ``18 02`` and ``84,48`` have one, ``1,234`` has thousands."""
    s = F.regexp_replace(F.replace(token, F.lit("·"), F.lit(".")), r"^(\d+) (\d{1,2})$", "$1.$2")
    return F.when(~F.contains(s, F.lit(".")) & s.rlike(r"^[^,]*,\d{1,2}$"), F.replace(s, F.lit(","), F.lit("."))).otherwise(F.replace(s, F.lit(","), F.lit("")))


#: Characters that recognition takes for digits, and the digits (fixed values).
CONFUSABLE = ("OoQDlISsBZG/|(){}[]!", "00001155826111111111")
#: Longest token that is repaired, and the most characters replaced in it (fixed values).
LONGEST_TOKEN, MOST_REPLACED = 16, 3


def recognised(text: Column, most: int = MOST_REPLACED) -> Column:
    """A recognised number: currency signs and trailing marks dropped, separators resolved, and at most ``most`` confusable
    characters, from the left, read as digits. Null if that gives no number, or the token is too long."""
    token = F.regexp_replace(F.regexp_replace(text, "^[$€£¥ \\t]+", ""), "[$€£¥ \\t.,;:]+$", "")
    s = decimal_separators(token)
    strange = r"[^0-9.]"
    read = F.translate(s, *CONFUSABLE)
    few = F.length(F.regexp_replace(s, r"[0-9.]", "")) <= most
    digits = r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"
    return F.when(
        F.length(token).between(1, LONGEST_TOKEN),
        F.coalesce(F.when(s.rlike(digits), s.try_cast(AMOUNT)), F.when(s.rlike(strange) & few & read.rlike(digits), read.try_cast(AMOUNT))),
    )


@dataclass(frozen=True)
class DutyRates:
    """Shares of the dutiable value, and the exchange rate (fixed values)."""

    service: float = 0.06
    vat: float = 0.15
    exchange: float = 2.7169
    common: float = 0.20


def rounded(value: Column) -> Column:
    """Two decimals, half up, by decimal arithmetic."""
    return F.round(value.cast("decimal(28,8)"), 2).cast("decimal(18,2)")


def duties(cif: Column, rate: Column, rates: DutyRates = DutyRates()) -> dict[str, Column]:
    """Duties of a value in foreign currency; every step is rounded, as each amount stands on the form by itself."""
    exact = lambda x: F.lit(str(x)).cast("decimal(10,6)")
    local = rounded(cif.cast("decimal(18,2)") * exact(rates.exchange))
    customs = rounded(local * F.coalesce(rate.cast("decimal(10,6)"), exact(rates.common)))
    service = rounded(local * exact(rates.service))
    vat = rounded((local + customs + service).cast("decimal(18,2)") * exact(rates.vat))
    return {"cif_local": local, "customs": customs, "service": service, "vat": vat, "duties": (customs + service + vat).cast("decimal(18,2)")}


def value_behind(duty: Column, rate: Column, freight: Column, insurance: Column, rates: DutyRates = DutyRates()) -> Column:
    """The items' value that a duty amount implies, at least 0."""
    share = F.lit(1 + rates.vat) * rate + F.lit(rates.service * (1 + rates.vat) + rates.vat)
    found = (duty / share / F.lit(rates.exchange) - freight - insurance).cast("decimal(28,8)")
    return F.greatest(rounded(found), F.lit(0).cast("decimal(18,2)"))
