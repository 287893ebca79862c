"""Format-preserving Feistel pseudonyms (operator 4), all DataFrame expressions.

A found value is checked (card numbers by their check digit, phone numbers by
the numbering plan unless their layout is a full one (+1 or an area code in
parentheses), addresses by the octets' range, social security numbers by
the issued ranges, dates by the calendar), ranked within the values of its
format, permuted there under a key, and written back in the same layout.  The
permutation is a Feistel network over a product Z_a x Z_b whose size is just the
number of valid values, so every pseudonym is itself valid, different values
stay different, and equal values get equal pseudonyms in all documents, without
any table that grows with them.  Mail addresses keep their domain and shape;
their local part gets a keyed digest, as its format is not a fixed set.

A card number may stand beside other digits: in a run of groups that is no number
as a whole, the leftmost valid one between spaces counts, the longest from there.

Rounds take their words from SHA-256 over key, format, round and half.

Defined results: a null text stays null; invalid look-alikes stay as they are;
equal rows give equal rows; an empty table gives an empty result; other columns
are kept by ``pseudonymised`` and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapane.llm.common import let, table

ROUNDS = 8
KEY = "terrapane-demo-key"

# The formats' patterns, tried in this order.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"  # possessive: no recursion
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![\w]|\.[0-9])"
PHONE = r"(?<!\w)(?:(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])|\([0-9]{3}\) ?)[0-9]{3}|[2-9][0-9]{2}[ .-][2-9][0-9]{2})[ .-][0-9]{4}(?!\w)"
SSN = r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])"
DATE = r"(?<![\w-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?!(?!T[0-9])[\w-])"
CARD = r"(?<![\w.-])(?:[0-9]{13,19}|[0-9](?:[ -]?[0-9]){12,18})(?![\w-])"
FORMATS = {"email": EMAIL, "ipv4": IPV4, "phone": PHONE, "ssn": SSN, "date": DATE, "card": CARD}
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31

ANY = "|".join(FORMATS.values())


@dataclass(frozen=True)
class Pseudonyms:
    key: str = KEY

    def permuted(self, tag: str, x: Column, y: Column, a: Column | int, b: Column | int) -> Column:
        """struct(x, y): the image of (x, y) in Z_a x Z_b."""
        a, b = (v if isinstance(v, Column) else F.lit(v) for v in (a, b))

        def turn(acc: Column, i: Column) -> Column:
            left = F.pmod(acc["x"] + self.word(tag, i, acc["y"]), a.cast("long"))
            right = F.pmod(acc["y"] + self.word(tag, i, acc["x"]), b.cast("long"))
            return F.when(i % 2 == 0, F.struct(left.alias("x"), acc["y"].alias("y"))).otherwise(F.struct(acc["x"].alias("x"), right.alias("y")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(x.cast("long").alias("x"), y.cast("long").alias("y")), turn)

    def word(self, tag: str, i: Column, half: Column) -> Column:
        """A keyed word under 16^14."""
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(self.key), F.lit(tag), i.cast("string"), half.cast("string")), 256), 1, 14), 16, 10).cast("long")

    def email(self, v: Column) -> Column:
        local = F.substring_index(v, "@", 1)
        return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(self.key), F.lit("email"), local), 256), 1, 12), F.lit("@"), F.substring_index(v, "@", -1))

    def ipv4(self, v: Column) -> Column:
        def go(o: Column) -> Column:
            p = self.permuted("ipv4", F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), 65536, 65536)
            return let(p, lambda q: F.concat_ws(".", *(x.cast("string") for x in (F.floor(q["x"] / 256), q["x"] % 256, F.floor(q["y"] / 256), q["y"] % 256))))

        return let(F.transform(F.split(v, r"\."), lambda s: s.cast("long")), go)

    def digits(self, v: Column) -> Column:
        return F.regexp_replace(v, "[^0-9]", "")

    def laid_out(self, v: Column, digits: Column) -> Column:
        """``digits`` in the layout of ``v``: its other characters stay in place."""
        chars = F.split(v, "")

        def go(s: Column) -> Column:
            step = lambda acc, c: F.struct((acc["k"] + c.rlike("[0-9]").cast("int")).alias("k"), F.concat(acc["t"], F.when(c.rlike("[0-9]"), F.substr(digits, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("t"))
            return F.aggregate(s, F.struct(F.lit(0).alias("k"), F.lit("").alias("t")), step)["t"]

        return let(chars, go)

    def phone(self, v: Column) -> Column:
        """Area and exchange are 200 to 999; 800 * 800 * 10,000 numbers.

        The other 360,000 pairs of codes, which only full layouts have, are permuted among themselves.
        """

        def go(d: Column) -> Column:
            ten = F.right(d, F.lit(10))
            area, exchange = F.substring(ten, 1, 3).cast("long"), F.substring(ten, 4, 3).cast("long")
            usual = (area >= 200) & (exchange >= 200)
            # areas under 200 first, then exchanges under 200
            other = F.when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
            p = self.permuted("phone", F.when(usual, (area - 200) * 800 + exchange - 200).otherwise(other), F.substring(ten, 7, 4), F.when(usual, 640_000).otherwise(360_000), 10_000)

            def written(q: Column) -> Column:
                x = q["x"]
                codes = F.when(usual, (F.floor(x / 800) + 200) * 1000 + x % 800 + 200).when(x < 200_000, x).otherwise((F.floor((x - 200_000) / 200) + 200) * 1000 + (x - 200_000) % 200)
                return F.concat(F.lpad(codes.cast("string"), 6, "0"), F.lpad(q["y"].cast("string"), 4, "0"))

            return F.concat(F.substr(d, F.lit(1), F.length(d) - 10), let(p, written))

        return self.laid_out(v, let(self.digits(v), go))

    def ssn(self, v: Column) -> Column:
        """Areas 001 to 899 without 666, groups from 01, serials from 0001."""
        area = F.substring(v, 1, 3).cast("long")
        rank = F.when(area > 666, area - 2).otherwise(area - 1)
        y = (F.substring(v, 5, 2).cast("long") - 1) * 9999 + F.substring(v, 8, 4).cast("long") - 1
        p = self.permuted("ssn", rank, y, 898, 99 * 9999)
        return let(p, lambda q: F.concat_ws("-", F.lpad(F.when(q["x"] >= 665, q["x"] + 2).otherwise(q["x"] + 1).cast("string"), 3, "0"), F.lpad((F.floor(q["y"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((q["y"] % 9999 + 1).cast("string"), 4, "0")))

    def date(self, v: Column) -> Column:
        """73,049 = 319 * 229 days from 1900 to 2099."""

        def go(n: Column) -> Column:
            p = self.permuted("date", F.floor(n / 229), n % 229, 319, 229)
            return let(p, lambda q: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (q["x"] * 229 + q["y"]).cast("int")), "yyyy-MM-dd"))

        return let(F.datediff(F.try_to_date(v, "yyyy-MM-dd"), F.lit(FIRST_DAY).cast("date")).cast("long"), go)

    def card_within(self, v: Column) -> Column:
        """A run of digits with the card number in it rewritten."""
        return let(card_place(v), lambda s: F.concat(F.substr(v, F.lit(1), s["at"] - 1), self.card(F.substr(v, s["at"], s["n"])), F.substr(v, s["at"] + s["n"])))

    def card(self, v: Column) -> Column:
        """All digits but the last are permuted; the last is the check digit."""

        def go(d: Column) -> Column:
            n = F.length(d) - 1
            low = F.floor(n / 2).cast("int")
            high = n - low
            ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
            p = self.permuted("card", F.substr(d, F.lit(1), high), F.substr(d, high + 1, low), ten(high), ten(low))
            body = let(p, lambda q: F.concat(F.lpad(q["x"].cast("string"), high, F.lit("0")), F.lpad(q["y"].cast("string"), low, F.lit("0"))))
            return let(body, lambda b: F.concat(b, check_digit(b)))

        return self.laid_out(v, let(self.digits(v), go))


def luhn_sum(digits: Column) -> Column:
    """Sum with every second digit, from the last but one, doubled."""
    weighed = lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda a, x: a + x)


def check_digit(body: Column) -> Column:
    return F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")


def card_place(value: Column) -> Column:
    """struct(at, n): where in a run of digit groups the leftmost card number lies, the longest from there; else null.

    A number starts and ends with the run or at a space; a run has 19 digits at most.
    """

    def valid(digits: Column) -> Column:
        return F.length(digits).between(13, 19) & (luhn_sum(digits) % 10 == 0)

    n = F.length(value)
    places = F.sequence(F.lit(1), n)
    starts = F.filter(places, lambda p: (p == 1) | (F.substr(value, p - 1, F.lit(1)) == " "))
    ends = F.reverse(F.filter(places, lambda p: (p == n) | (F.substr(value, p + 1, F.lit(1)) == " ")))
    spans = F.flatten(F.transform(starts, lambda a: F.transform(ends, lambda e: F.struct(a.alias("at"), (e - a + 1).alias("n")))))
    return F.get(F.filter(spans, lambda s: let(F.regexp_replace(F.substr(value, s["at"], s["n"]), "[^0-9]", ""), valid)), 0)


def kind_of(value: Column) -> Column:
    """Name of the format that a found value is valid in, else null."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), "email").when(whole(IPV4), "ipv4").when(whole(PHONE), "phone").when(whole(SSN), "ssn")
        .when(whole(DATE) & F.try_to_date(value, "yyyy-MM-dd").isNotNull(), "date")
        .when(whole(CARD) & card_place(value).isNotNull(), "card")
    )


def pseudonym(value: Column, key: str = KEY) -> Column:
    """struct(kind, value): what stands for a found value; kind null where it stays."""
    p = Pseudonyms(key)

    def go(kind: Column) -> Column:
        new = F.when(kind == "email", p.email(value)).when(kind == "ipv4", p.ipv4(value)).when(kind == "phone", p.phone(value)).when(kind == "ssn", p.ssn(value)).when(kind == "date", p.date(value)).when(kind == "card", p.card_within(value)).otherwise(value)
        return F.struct(kind.alias("kind"), new.alias("value"))

    return let(kind_of(value), go)


def rewritten(text: Column, key: str = KEY) -> Column:
    """struct(text, kinds): the text with pseudonyms, and the kinds found in order."""

    def build(gaps: Column, new: Column) -> Column:
        body = F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(new)), new, lambda g, v: F.concat(g, v["value"])), "")
        return F.struct(F.concat(body, F.element_at(gaps, -1)).alias("text"), F.filter(F.transform(new, lambda v: v["kind"]), lambda k: k.isNotNull()).alias("kinds"))

    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: pseudonym(m, key))
    some = let(F.struct(F.split(text, ANY, -1).alias("g"), found.alias("v")), lambda x: build(x["g"], x["v"]))
    plain = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(text.rlike("[0-9]|@"), some).otherwise(plain)


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text``."""
    return docs.withColumn("text", F.when(F.col("text").isNotNull(), rewritten(F.col("text"), key)["text"]))


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the rewritten text and the number of values of each kind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), rewritten(F.col("text"))).alias("r"))
    count = lambda k: F.coalesce(F.size(F.filter("r.kinds", lambda x: x == k)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("r.text").alias("text"), *(count(k).alias(f"n_{k}") for k in FORMATS))


QUERIES = {"op4_feistel_pii": op4_feistel_pii}
