"""PII: validated numbers and dates are replaced by Feistel pseudonyms of the same format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import boxed, table, unboxed

#: The query's key. Whoever has a key can undo the permutations: give pseudonymised() one of your own, from a secret store.
QUERY_KEY = "pseudonym-key-1"
ROUNDS = 8
#: What may stand before and after a number: nothing that would go on with it.
_LEFT, _RIGHT = r"(?<![0-9A-Za-z_.+-])", r"(?![0-9A-Za-z_]|[.-][0-9])"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
CARD = r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19}"
#: The first two digits and the lengths of card numbers that issuers use.
ISSUED = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|35[0-9]{14}|(?:5[06-9]|6[0-9])[0-9]{11,17})$"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}"
SECRET = r"(?<=[\"'=: ])[0-9a-f]{40}(?=[\"' ,;]|$)"
#: A date may also stand before a time.
STAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[Tt_][0-9]{2}:)"
ANY = f"(?<![A-Za-z0-9._%+-]){EMAIL}|{SECRET}|{_LEFT}(?:(?:{IPV4}|{SSN}|{DATE}|{PHONE}|{CARD}){_RIGHT}|{STAMP})"
#: A quick look before ANY. Every match of ANY has one of these: an email an @, a secret 40 hex digits, all others two digits
#: in a row or with a dot between them. Texts without any are not searched.
HINT = r"[0-9][0-9.]?[0-9]|@|[0-9a-f]{40}"
#: Fixed value: the days of the 400 years from 1800-01-01 that dates are permuted in, 773 * 189.
DAYS = (773, 189)


def _prf(kind: str, key: str, step: Column, x: Column, m: Column) -> Column:
    """A keyed pseudo-random number under m."""
    text = F.concat_ws(":", F.lit(f"{key}:{kind}"), step.cast("string"), x.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), m)


def _div(n: Column, m: Column | int) -> Column:
    """Whole-number division of numbers that are not negative; through decimals, as / on longs would round."""
    m = m if isinstance(m, Column) else F.lit(m).cast("long")
    return ((n - F.pmod(n, m)).cast("decimal(20,0)") / m.cast("decimal(20,0)")).cast("long")


def permuted(kind: str, key: str, n: Column, a: Column | int, b: Column | int) -> Column:
    """A keyed permutation of the numbers under a * b: n = left * b + right, and rounds that add to either half in turn
    a keyed function of the other one, modulo a or b. Every round can be undone, so that equal values stay equal and
    different ones different, without cycles to walk."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("long") for x in (a, b))

    def step(s: Column, r: Column) -> Column:
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, s["l"]).otherwise(F.pmod(s["l"] + _prf(kind, key, r, s["r"], a), a)).alias("l"),
            F.when(odd, F.pmod(s["r"] + _prf(kind, key, r, s["l"], b), b)).otherwise(s["r"]).alias("r"),
        )

    start = F.struct(_div(n, b).alias("l"), F.pmod(n, b).alias("r"))
    return F.aggregate(F.array(*(F.lit(k) for k in range(ROUNDS))), start, step, lambda s: s["l"] * b + s["r"])


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """The Luhn sum of a digit string; every second digit from the right counts double, from place doubled_from on."""
    places = F.sequence(F.lit(0), F.length(digits) - 1)

    def add(total: Column, k: Column) -> Column:
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(k % 2 == doubled_from % 2, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def _refilled(hit: Column, digits: Column) -> Column:
    """hit with its digits replaced by digits, one by one; everything else stays in its place."""
    chars = F.split(hit, "")

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(s["out"], F.when(is_digit, F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + F.when(is_digit, 1).otherwise(0)).alias("at")
        )

    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s["out"])


def _pad(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _pow10(k: Column) -> Column:
    """10 ** k as a whole number."""
    return F.rpad(F.lit("1"), k + 1, "0").cast("long")


def pseudonym(hit: Column, key: str) -> Column:
    """The pseudonym of a match of ANY, or the match itself where it is not valid.

    Cards: 13 to 19 digits that begin as an issuer's (ISSUED) and whose Luhn sum is right; the first two digits stay, those
    before the check digit are permuted and the check digit follows. Phones: all of the format; those with area and exchange from 200 are permuted among themselves, the others too.
    SSN: area 001-899 but 666, group and serial not 0. IPv4: octets to 255 without leading zeros. Dates: real ones from
    1800 to 2199, one permutation of days for all formats. Email: the name before @ becomes u and 128 bits of a keyed hash;
    the domain stays. 40 hex digits in a quote or after = become others, 160 bits of a keyed hash.
    """
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    card_ok = digits.rlike(ISSUED) & (luhn_sum(digits, 1) % 10 == 0)
    payload = F.substring(digits, F.lit(3), n - 3)
    half = F.floor((n - 3) / 2).cast("int")
    moved = F.concat(F.substring(digits, 1, 2), _pad(permuted("card", key, payload.cast("long"), _pow10(half), _pow10(n - 3 - half)), n - 3))
    card = _refilled(hit, F.concat(moved, F.pmod(10 - luhn_sum(moved, 0) % 10, F.lit(10)).cast("string")))

    ten = F.substring(digits, n - 9, F.lit(10))
    area, exchange, line = (F.substring(ten, F.lit(i), F.lit(k)).cast("long") for i, k in ((1, 3), (4, 3), (7, 4)))
    phone_ok = (n == 10) | (n == 11) & (F.substring(digits, F.lit(1), F.lit(1)) == "1")
    # 800 exchanges in each of 800 areas, and all other fronts: 1000 in each of 200 areas, then 200 in each of 800
    dialled = (area >= 200) & (exchange >= 200)
    front = F.when(dialled, (area - 200) * 800 + exchange - 200).when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    side = F.when(dialled, F.lit(80000)).otherwise(F.lit(60000)).cast("long")

    def told_front(f: Column) -> Column:
        rest = F.greatest(f - 200_000, F.lit(0).cast("long"))
        return (
            F.when(dialled, (_div(f, 800) + 200) * 1000 + F.pmod(f, F.lit(800)) + 200)
            .when(f < 200_000, f).otherwise((_div(rest, 200) + 200) * 1000 + F.pmod(rest, F.lit(200)))
        )

    moved_phone = F.transform(F.array(permuted("phone", key, front * 10000 + line, side, side)), lambda p: F.struct(_div(p, 10000).alias("f"), F.pmod(p, F.lit(10000)).alias("line")))
    told = F.transform(moved_phone, lambda x: F.concat(_pad(told_front(x["f"]), 6), _pad(x["line"], 4)))[0]
    phone = _refilled(hit, F.concat(F.when(n == 11, "1").otherwise(""), told))

    s_area, group, serial = (F.substring(digits, F.lit(i), F.lit(k)).cast("long") for i, k in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = s_area.between(1, 899) & (s_area != 666) & (group > 0) & (serial > 0)
    s = permuted("ssn", key, ((s_area - F.when(s_area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999)
    top = _div(s, 9999)
    new_area = _div(top, 99) + 1
    ssn = F.concat_ws("-", _pad(F.when(new_area >= 666, new_area + 1).otherwise(new_area), 3), _pad(F.pmod(top, F.lit(99)) + 1, 2), _pad(F.pmod(s, F.lit(9999)) + 1, 4))

    octets = F.split(hit, r"\.")
    ip_ok = F.forall(octets, lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda t, o: t * 256 + o.cast("long"))
    moved_ip = permuted("ip", key, number, 65536, 65536)
    ip = F.concat_ws(".", *(F.shiftright(moved_ip, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)))

    kind = F.when(hit.rlike("-"), "yyyy-MM-dd").when(hit.rlike(r"\."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    pick = lambda i, k: F.substring(hit, F.lit(i), F.lit(k))
    iso = F.when(kind == "yyyy-MM-dd", hit).when(kind == "dd.MM.yyyy", F.concat_ws("-", pick(7, 4), pick(4, 2), pick(1, 2))).otherwise(F.concat_ws("-", pick(7, 4), pick(1, 2), pick(4, 2)))
    day = iso.try_cast("date")
    since = F.datediff(day, F.lit("1800-01-01").cast("date")).cast("long")
    date_ok = day.isNotNull() & since.between(0, DAYS[0] * DAYS[1] - 1)
    new = F.date_add(F.lit("1800-01-01").cast("date"), permuted("date", key, since, *DAYS).cast("int")).cast("string")
    y, m, d = (F.substring(new, F.lit(i), F.lit(k)) for i, k in ((1, 4), (6, 2), (9, 2)))
    date = F.when(kind == "yyyy-MM-dd", new).when(kind == "dd.MM.yyyy", F.concat_ws(".", d, m, y)).otherwise(F.concat_ws("/", m, d, y))

    name = F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}:email:"), F.lower(hit)), 256), 1, 32))
    email = F.concat(name, F.regexp_extract(hit, "(@.*)$", 1))
    secret = F.substring(F.sha2(F.concat(F.lit(f"{key}:secret:"), hit), 256), 1, 40)

    full = lambda pattern: hit.rlike(f"^(?:{pattern})$")
    out = (
        F.when(hit.rlike("@"), email)
        .when(hit.rlike("^[0-9a-f]{40}$"), secret)
        .when(full(SSN), F.when(ssn_ok, ssn))
        .when(full(IPV4), F.when(ip_ok, ip))
        .when(full(DATE), F.when(date_ok, date))
        .when(full(PHONE), F.when(phone_ok, phone))
        .when(full(CARD), F.when(card_ok, card))
    )
    return F.coalesce(out, hit)


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Every row of docs with its columns, _text: with pseudonyms, and _found: how many values were replaced.

    Null text stays null, empty text empty (both with 0 found). What is not valid stays as it is. The same value gets
    the same pseudonym in every row, repeated ones too. Different numbers and dates of a kind get different ones, always;
    different emails and secrets do but for equal hashes of 128 and 160 bits. Long texts are searched whole. Columns of the
    names _text and _found are replaced, all others stay; no id is read, and an empty table gives an empty one.
    """
    rows = boxed(docs, t=F.col(text))
    rows = rows.withColumn("hits", F.when(F.col("t").rlike(HINT), F.regexp_extract_all("t", F.lit(ANY), F.lit(0))))
    rows = rows.withColumn("new", F.when(F.size("hits") > 0, F.transform("hits", lambda h: pseudonym(h, key))))
    put = F.zip_with(F.split("t", ANY, -1), "new", lambda p, h: F.concat(p, F.coalesce(h, F.lit(""))))
    found = F.size(F.filter(F.zip_with("hits", "new", lambda h, x: h != x), lambda x: x))
    some = F.size("hits") > 0
    return unboxed(rows, _text=F.when(some, F.array_join(put, "")).otherwise(F.col("t")), _found=F.when(some, found).otherwise(0).cast("long"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms in place of personal numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymised(docs, QUERY_KEY).select("doc_id", F.col("_found").alias("n_replaced"), F.col("_text").alias("text"))
