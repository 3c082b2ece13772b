"""Phone candidates, numbering plans and E.164.

Validity is checked against the plan rows below (pattern level). An international number of a country
without a row is taken as it is; add a row to check it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..fixed_values import DEFAULT_REGION, PHONE_PATTERN, TEL_PATTERN
from .text import bind, constant_map, strip


@dataclass(frozen=True)
class NumberingPlan:
    region: str
    code: str            # country calling code
    trunk: str           # national prefix, dropped in international form
    exit_code: str       # international dialling prefix, as a pattern
    mobile: str          # national significant numbers that reach a mobile phone
    fixed: str           # all others
    groups: tuple        # (pattern of the E.164 form, spaced display form)
    service: dict = field(default_factory=dict)  # kind -> numbers of that kind, whatever range they lie in


# fixed values: numbers that belong to no place and no mobile phone, by kind, from the same lists
SERVICE_NUMBERS = {
    "SA": {"toll_free": "800[0-9]{7}", "shared_cost": "92[05][0-9]{6}", "uan": "811[0-9]{7}"},
    "AE": {"toll_free": "800[0-9]{2,9}|400[0-9]{6}", "shared_cost": "700[05][0-9]{5}", "premium": "900[02][0-9]{5}", "uan": "600[25][0-9]{5}"},
    "KW": {"toll_free": "18[0-9]{5}"},
    "QA": {"toll_free": "800[0-9]{4}"},
    "BH": {"toll_free": "8[02369][0-9]{6}", "shared_cost": "84[0-9]{6}", "premium": "90[0-9]{6}"},
    "OM": {"toll_free": "8007[0-9]{4,5}|(?:500|800[05])[0-9]{4}", "premium": "900[0-9]{5}"},
    "JO": {"toll_free": "80[0-9]{6}", "shared_cost": "85[0-9]{6}", "premium": "9[0-9]{7}", "uan": "8(?:10|8[0-9])[0-9]{5}"},
    "LB": {"shared_cost": "80[0-9]{6}", "premium": "9[01][0-9]{6}"},
    "PS": {"toll_free": "1800[0-9]{6}", "shared_cost": "1700[0-9]{6}"},
    "MA": {"toll_free": "80[0-7][0-9]{6}", "premium": "89[0-9]{7}"},
    "DZ": {"toll_free": "800[0-9]{6}", "shared_cost": "80[12]1[0-9]{5}", "premium": "80[3-689]1[0-9]{5}"},
    "TN": {"toll_free": "8010[0-9]{4}", "shared_cost": "8[12]10[0-9]{4}", "premium": "88[0-9]{6}"},
    "TR": {"toll_free": "800[0-9]{7}", "premium": "900[0-9]{7}", "uan": "444[0-9]{4}|850[0-9]{7}"},
    "GB": {"toll_free": "80[08][0-9]{7}|800[0-9]{6}", "shared_cost": "8(?:4[2-5]|7[0-3])[0-9]{7}", "premium": "9(?:[01][0-9]|8[2-49])[0-9]{7}", "uan": "3[0347][0-9]{8}"},
    "FR": {"toll_free": "80[0-5][0-9]{6}", "shared_cost": "8(?:1[0-29]|2[0156]|84)[0-9]{6}", "premium": "89[0-9]{7}", "uan": "80[6-9][0-9]{6}"},
    "DE": {"toll_free": "800[0-9]{7,12}", "shared_cost": "180[0-9]{5,11}", "premium": "900[0-9]{7}"},
    "IT": {"toll_free": "80(?:0[0-9]{6}|3[0-9]{3})", "shared_cost": "84[0178][0-9]{3,6}", "premium": "89[0-9]{4,8}"},
    "ES": {"toll_free": "[89]00[0-9]{6}", "shared_cost": "90[12][0-9]{6}", "premium": "80[367][0-9]{6}"},
    "PT": {"toll_free": "80[02][0-9]{6}", "shared_cost": "80[89][0-9]{6}", "uan": "70[78][0-9]{6}"},
    "NL": {"toll_free": "800[0-9]{4,7}", "premium": "90[069][0-9]{4,7}"},
    "BE": {"toll_free": "800[1-9][0-9]{4}", "shared_cost": "78[0-9]{6}", "premium": "90[0-9]{6}"},
    "AT": {"toll_free": "800[0-9]{6,10}", "shared_cost": "8(?:10|2[018])[0-9]{6,10}", "premium": "9(?:0[01]|3[019])[0-9]{6,10}"},
    "SE": {"toll_free": "20[0-9]{4,7}", "shared_cost": "77[0-9]{7}", "premium": "9(?:00|39|44)[0-9]{4,7}"},
    "DK": {"toll_free": "80[0-9]{6}", "premium": "90[0-9]{6}"},
    "PL": {"toll_free": "800[0-9]{6,7}", "shared_cost": "801[0-9]{6}", "premium": "70[01346-8][0-9]{6}", "uan": "804[0-9]{6}"},
    "GR": {"toll_free": "800[0-9]{7,9}", "shared_cost": "8(?:0[16]|12|[27]5|50)[0-9]{7}", "premium": "90[19][0-9]{7}"},
    "IE": {"toll_free": "1800[0-9]{6}", "shared_cost": "18[59]0[0-9]{6}", "premium": "15[0-8]{2}[0-9]{6}", "uan": "818[0-9]{6}"},
    "IN": {"toll_free": "1800[0-9]{4,9}", "shared_cost": "1860[0-9]{7}"},
}

# fixed values: numbering plans
PLANS = [
    NumberingPlan(
        "EG", "20", "0", "00",
        mobile=r"1[0125][0-9]{8}",
        fixed=(r"2[0-9]{8}|3[0-9]{7}"
               r"|(?:13|15|4[05-8]|5[057]|6[24-689]|8[2468]|9[235-7])[0-9]{7}"),
        service={"toll_free": "800[0-9]{7}", "premium": "900[0-9]{7}"},
        groups=((r"^\+20(1[0-9]{2})([0-9]{3})([0-9]{4})$", "+20 $1 $2 $3"),
                (r"^\+20([89]00)([0-9]{3})([0-9]{4})$", "+20 $1 $2 $3"),
                (r"^\+20([23])([0-9]{7,8})$", "+20 $1 $2"),
                (r"^\+20([0-9]{2})([0-9]{7})$", "+20 $1 $2"))),
    NumberingPlan(
        "US", "1", "1", "011",
        mobile=r"[2-9][0-9]{2}[2-9][0-9]{6}",   # fixed and mobile share one range
        fixed="", service={"toll_free": "8(?:00|33|44|55|66|77|88)[2-9][0-9]{6}", "premium": "900[2-9][0-9]{6}"},
        groups=((r"^\+1([0-9]{3})([0-9]{3})([0-9]{4})$", "+1 $1-$2-$3"),)),
    # patterns of length and leading digits, from the ITU's public lists of national numbering plans
    *[NumberingPlan(region, code, trunk, "00", mobile, fixed, ((rf"^\+{code}([0-9]+)$", f"+{code} $1"),), SERVICE_NUMBERS.get(region, {}))
      for region, code, trunk, mobile, fixed in (
        ("SA", "966", "0", "5[0-9]{8}", "1[1-7][0-9]{7}"),
        ("AE", "971", "0", "5[024568][0-9]{7}", "[234679][0-9]{7}"),
        ("KW", "965", "", "[569][0-9]{7}", "2[0-9]{7}"),
        ("QA", "974", "", "[3567][0-9]{7}", "4[0-9]{7}"),
        ("BH", "973", "", "[36][0-9]{7}", "1[0-9]{7}"),
        ("OM", "968", "", "[79][0-9]{7}", "2[0-9]{7}"),
        ("YE", "967", "0", "7[01378][0-9]{7}", "[1-7][0-9]{6,7}"),
        ("IQ", "964", "0", "7[3-9][0-9]{8}", "[1-6][0-9]{6,8}"),
        ("JO", "962", "0", "7[789][0-9]{7}", "[2356][0-9]{7}"),
        ("LB", "961", "0", "3[0-9]{6}|(?:7[016-9]|81)[0-9]{6}", "[14-9][0-9]{6}"),
        ("SY", "963", "0", "9[0-9]{8}", "[1-5][0-9]{7,8}"),
        ("PS", "970", "0", "5[69][0-9]{7}", "[2489][0-9]{7}"),
        ("MA", "212", "0", "[67][0-9]{8}", "5[0-9]{8}"),
        ("DZ", "213", "0", "[567][0-9]{8}", "[1-4][0-9]{7}"),
        ("TN", "216", "", "[2459][0-9]{7}", "[37][0-9]{7}"),
        ("LY", "218", "0", "9[0-9]{8}", "[2-8][0-9]{7,8}"),
        ("SD", "249", "0", "9[0-9]{8}", "1[0-9]{8}"),
        ("TR", "90", "0", "5[0-9]{9}", "[234][0-9]{9}"),
        ("GB", "44", "0", "7[1-57-9][0-9]{8}", "[1-3][0-9]{8,9}"),
        ("FR", "33", "0", "[67][0-9]{8}", "[1-589][0-9]{8}"),
        ("DE", "49", "0", "1[5-7][0-9]{8,9}", "[2-9][0-9]{5,10}"),
        ("IT", "39", "", "3[0-9]{8,9}", "0[0-9]{5,10}"),
        ("ES", "34", "", "[67][0-9]{8}", "[89][0-9]{8}"),
        ("PT", "351", "", "9[0-9]{8}", "2[0-9]{8}"),
        ("NL", "31", "0", "6[1-58][0-9]{7}", "[1-57-9][0-9]{8}"),
        ("BE", "32", "0", "4[5-9][0-9]{7}", "[1-9][0-9]{7}"),
        ("AT", "43", "0", "6[5-9][0-9]{8,11}", "[1-57][0-9]{3,11}"),
        ("SE", "46", "0", "7[0-9]{8}", "[1-689][0-9]{6,8}"),
        ("DK", "45", "", "[2-9][0-9]{7}", ""),
        ("PL", "48", "", "[4-8][0-9]{8}", "[1-3][0-9]{8}"),
        ("GR", "30", "", "69[0-9]{8}", "2[0-9]{9}"),
        ("IE", "353", "0", "8[35-9][0-9]{7}", "[1-79][0-9]{6,8}"),
        ("IN", "91", "0", "[6-9][0-9]{9}", "[1-5][0-9]{9}"),
    )],
]
_DIGITS = "".join(chr(z + d) for z in (0x0660, 0x06F0, 0xFF10) for d in range(10)) + "\uff0b"
_ASCII = "0123456789" * 3 + "+"


def _plan(region: str) -> NumberingPlan:
    return next(p for p in PLANS if p.region == region)


def _national(plan: NumberingPlan) -> str:
    return "|".join(x for x in (plan.mobile, plan.fixed, *plan.service.values()) if x)


def _by_code(values: dict[str, str], digits: Column, body) -> Column:
    """``body`` of (calling code, what stands at it), NULLs if no known code begins the digits: one look-up for each length of a code."""
    table = constant_map(values)
    sizes = sorted({len(c) for c in values}, reverse=True)
    found = F.coalesce(*[F.when(F.try_element_at(table, F.substring(digits, 1, n)).isNotNull(), F.struct(
        F.substring(digits, 1, n).alias("code"), F.try_element_at(table, F.substring(digits, 1, n)).alias("value"))) for n in sizes])
    return bind(found, lambda f: body(f["code"], f["value"]))


#: calling code -> pattern of a whole number, trunk prefix allowed; its only group is the national number
_WHOLE = {p.code: rf"^{p.code}(?:{p.trunk})?({_national(p)})$" for p in PLANS}


def normalize_phone(raw: Column, region: str = DEFAULT_REGION) -> Column:
    """E.164 form, or '' where the text is no valid number of a known plan.

    A number is tried in the home plan; behind an international prefix its calling code finds the one plan that counts. Steps on the
    text are a chain in which each uses the previous one once.
    """
    home = _plan(region)
    n = F.translate(F.coalesce(raw, F.lit("")), _DIGITS, _ASCII)
    n = F.regexp_extract(n, r"(?s)[+0-9].*", 0)
    n = F.regexp_replace(n, r"(?s)^.*\p{L}.*$", "")
    n = F.regexp_replace(n, r"[^0-9+]", "")
    n = F.regexp_replace(n, r"(?<!^)\+", "")
    # +... for a number of the home plan and for an international one as it was dialled, which is told by its first sign
    n = F.regexp_replace(n, rf"^(?:\+{home.code}|{home.exit_code}{home.code}|{home.code})?(?:{home.trunk})?({_national(home)})$", f"ok+{home.code}$1")
    n = F.regexp_replace(n, rf"^(?:\+|{home.exit_code})([1-9][0-9]*)$", "$1 ")

    def plan(code: Column, pattern: Column, digits: Column) -> Column:
        national = F.call_function("regexp_extract", digits, pattern, F.lit(1))
        checked = bind(national, lambda x: F.when(x != "", F.concat(F.lit("+"), code, x)).otherwise(""))
        return F.when(pattern.isNotNull(), checked).when(F.length(digits).between(8, 15), F.concat(F.lit("+"), digits)).otherwise("")

    def told(n: Column) -> Column:
        abroad = bind(F.rtrim(n), lambda digits: _by_code(_WHOLE, digits, lambda code, pattern: plan(code, pattern, digits)))
        return F.when(n.startswith("ok"), F.substring(n, 3, 20)).when(n.endswith(" "), abroad).otherwise("")

    return bind(n, told)


def _any_plan(numbers) -> str:
    return "|".join(rf"^\+{p.code}(?:{x})$" for p in PLANS for x in [numbers(p)] if x)


def phone_kind(e164: Column) -> Column:
    """toll_free, shared_cost, premium, uan, mobile or fixed; '' for a number of no known plan."""
    kinds = sorted({k for p in PLANS for k in p.service})
    out = F.when(e164.rlike(_any_plan(lambda p: p.service.get(kinds[0], ""))), kinds[0])
    for kind in kinds[1:]:
        out = out.when(e164.rlike(_any_plan(lambda p, kind=kind: p.service.get(kind, ""))), kind)
    return out.when(e164.rlike(_any_plan(lambda p: p.mobile)), "mobile").when(e164.rlike(_any_plan(lambda p: p.fixed)), "fixed").otherwise("")


def is_mobile(e164: Column) -> Column:
    """True for ranges that may be mobile (in some plans fixed and mobile share a range), but for service numbers among them."""
    return e164.rlike(_any_plan(lambda p: p.mobile)) & ~e164.rlike(_any_plan(lambda p: "|".join(p.service.values())))


def format_international(e164: Column) -> Column:
    """Spaced display form of an E.164 number; '' stays ''."""
    own = {p.code: p for p in PLANS if len(p.groups) > 1 or "$2" in p.groups[0][1]}

    def shown(code: Column, _: Column) -> Column:
        plain = F.concat(F.lit("+"), code, F.lit(" "), F.substring(e164, F.length(code) + 2, F.length(e164)))
        out = F.when(code.isNull(), e164)
        for c, plan in own.items():
            grouped = e164
            for pattern, form in plan.groups:
                grouped = F.regexp_replace(grouped, pattern, form)
            out = out.when(code == c, grouped)
        return out.otherwise(plain)

    return _by_code({p.code: p.region for p in PLANS}, F.substring(e164, 2, 3), shown)


def phone_candidates(text: Column) -> Column:
    """Phone-like strings of 8 to 15 digits-and-plus, tel: links first, distinct by digits."""
    text = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(text, F.lit(TEL_PATTERN), F.lit(1)),
                     F.regexp_extract_all(text, F.lit(PHONE_PATTERN), F.lit(0)))
    marked = F.transform(found, lambda c: F.struct(
        F.regexp_replace(c, r"(?U)[^\d+]", "").alias("digits"), strip(c).alias("raw")))
    fit = F.filter(marked, lambda m: F.length(m["digits"]).between(8, 15))
    keyed = F.transform(fit, lambda m: F.struct(
        F.regexp_replace(m["digits"], r"^\++", "").alias("key"), m["raw"].alias("raw")))
    return _first_per_key(keyed)


def _first_per_key(keyed: Column) -> Column:
    """First raw text of each key, in order: sorted by (key, place), equal keys stand together."""
    placed = F.array_sort(F.transform(keyed, lambda m, i: F.struct(m["key"].alias("key"), i.alias("pos"), m["raw"].alias("raw"))))

    def firsts(sorted_: Column) -> Column:
        kept = F.filter(sorted_, lambda m, i: (i == 0) | (F.get(sorted_, i - 1)["key"] != m["key"]))
        in_order = F.array_sort(F.transform(kept, lambda m: F.struct(m["pos"].alias("pos"), m["raw"].alias("raw"))))
        return F.transform(in_order, lambda m: m["raw"])

    # evaluated once, although the comparison with the one before looks into it for each element
    return bind(placed, firsts)


def best_phones(candidates: Column, region: str = DEFAULT_REGION, most: int = 5) -> Column:
    """Valid distinct E.164 numbers of an ordered candidate array, mobiles first."""
    numbers = F.transform(candidates, lambda c: normalize_phone(c, region))
    valid = F.array_distinct(F.filter(numbers, lambda n: n != ""))
    ranked = bind(valid, lambda v: F.concat(F.filter(v, lambda n: is_mobile(n)), F.filter(v, lambda n: ~is_mobile(n))))
    return F.slice(ranked, 1, most)
