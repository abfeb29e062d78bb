"""List label formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols of roman numerals, from the largest (fixed values).
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
ONES = ("", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")


def letters(n: Column, upper: bool = False) -> Column:
    """a to z, aa to zz, aaa ...: one letter, repeated; empty below 1."""
    c = F.char(((n - 1) % 26 + (65 if upper else 97)).cast("int"))
    return F.when(n < 1, "").otherwise(F.repeat(c, (F.floor((n - 1) / 26) + 1).cast("int")))


def roman(n: Column, upper: bool = False) -> Column:
    """Roman numerals; the number itself outside 1 to 3999."""
    rest, out = n, F.lit("")
    for value, symbol in ROMAN:
        out = F.concat(out, F.repeat(F.lit(symbol), F.floor(rest / value).cast("int")))
        rest = rest % value
    out = out if upper else F.lower(out)
    return F.when((n < 1) | (n > 3999), n.cast("string")).otherwise(out)


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th, 11th, 21st."""
    teen = (n % 100).between(11, 13)
    end = F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), end)


def cardinal(n: Column) -> Column:
    """A number below a million in English words."""

    def below_hundred(x: Column) -> Column:
        ten, one = F.element_at(F.array(*map(F.lit, TENS)), F.floor(x / 10).cast("int") + 1), F.element_at(F.array(*map(F.lit, ONES)), (x % 10).cast("int") + 1)
        return F.when(x < 20, F.element_at(F.array(*map(F.lit, ONES)), F.least(x, F.lit(19)).cast("int") + 1)).otherwise(F.when(x % 10 == 0, ten).otherwise(F.concat(ten, F.lit("-"), one)))

    def below_thousand(x: Column) -> Column:
        hundred, rest = F.floor(x / 100), x % 100
        word = F.concat(F.element_at(F.array(*map(F.lit, ONES)), hundred.cast("int") + 1), F.lit(" hundred"))
        return F.when(hundred == 0, below_hundred(rest)).otherwise(F.when(rest == 0, word).otherwise(F.concat(word, F.lit(" "), below_hundred(rest))))

    thousand, rest = F.floor(n / 1000), n % 1000
    word = F.concat(below_thousand(thousand), F.lit(" thousand"))
    long = F.when(rest == 0, word).otherwise(F.concat(word, F.lit(" "), below_thousand(rest)))
    return F.when((n < 0) | (n > 999_999), n.cast("string")).when(n == 0, "zero").when(thousand == 0, below_thousand(rest)).otherwise(long)


#: Last words of a number whose ordinal isn't the word with "th" (fixed values).
ORDINAL_WORDS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def ordinal_words(n: Column) -> Column:
    """A number below a million as an English ordinal: twenty-second."""
    words = cardinal(n)
    last = F.regexp_extract(words, "([a-z]+)$", 1)
    head = words.substr(F.lit(1), F.length(words) - F.length(last))
    special = F.create_map(*[F.lit(x) for kv in ORDINAL_WORDS.items() for x in kv])
    tail = F.when(last.endswith("y"), F.concat(F.regexp_replace(last, "y$", "i"), F.lit("eth"))).otherwise(F.concat(last, F.lit("th")))
    return F.when(last == "", words).otherwise(F.concat(head, F.coalesce(F.element_at(special, last), tail)))


def label_number(n: Column, kind: Column) -> Column:
    """A counter in a level's format; unknown formats are decimal, none and bullet are empty."""
    return (
        F.when(kind == "lowerLetter", letters(n)).when(kind == "upperLetter", letters(n, True)).when(kind == "lowerRoman", roman(n)).when(kind == "upperRoman", roman(n, True))
        .when(kind == "decimalZero", F.when(n.between(0, 9), F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))).when(kind == "ordinal", ordinal(n)).when(kind == "cardinalText", cardinal(n)).when(kind == "ordinalText", ordinal_words(n))
        .when(kind.isin("none", "bullet"), "").otherwise(n.cast("string"))
    )
