"""Legal citations by pattern, with the offset of each match, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The citation patterns. Groups: number, then path.
SUBS = r"((?:\([a-z0-9]+\))*)"
ORDINALS = (
    "First Second Third Fourth Fifth Sixth Seventh Eighth Ninth Tenth Eleventh Twelfth Thirteenth Fourteenth Fifteenth Sixteenth Seventeenth Eighteenth "
    "Nineteenth Twentieth Twenty-first Twenty-second Twenty-third Twenty-fourth Twenty-fifth Twenty-sixth Twenty-seventh"
).split()


@dataclass(frozen=True)
class Pattern:
    kind: str
    system: str
    regex: str
    number: int
    path: int


RULES = (
    Pattern("FRE", "FRE", r"\bFRE\s+(\d{1,4})" + SUBS, 1, 2),
    Pattern("FRCP", "FRCP", r"\bFRCP\s+(\d{1,4})" + SUBS, 1, 2),
    Pattern("FRAP", "FRAP", r"\bFRAP\s+(\d{1,4})" + SUBS, 1, 2),
    Pattern("FEDR", "", r"\bFed\.\s*R\.\s*(Civ|Crim|App|Bankr|Evid)\.\s*P\.\s+(\d{1,4})" + SUBS, 2, 3),
    Pattern("PROSE", "", r"(?i)\bFederal\s+Rules?\s+of\s+(Evidence|Civil\s+Procedure|Appellate\s+Procedure)\s+(\d{1,4})" + SUBS, 2, 3),
    Pattern("MRPC", "MRPC", r"\b(?:Model\s+Rule|MRPC|M\.R\.P\.C\.)\s+(\d{1,4})((?:\.\d+)*(?:\([a-z0-9]+\))*)", 1, 2),
)
STATUTES = (
    Pattern("AMENDMENT", "US Const.", rf"\b({'|'.join(ORDINALS)})\s+Amendment\b", 1, 0),
    Pattern("ARTICLE", "US Const.", r"\bU\.?S\.?\s+Const(?:itution)?(?:\.|,)?\s+art\.?\s+([IVX]+)(?:\s*,\s*§\s*(\d+))?", 1, 2),
    Pattern("USC", "U.S.C.", r"\b(\d+)\s+U\.?\s*S\.?\s*C\.?\s+§+\s*(\d+[a-z]*)", 1, 2),
)
CASE = Pattern("CASE", "case", r"\b([A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+)*\s+v\.\s+[A-Z][A-Za-z.'-]+(?:\s+[A-Z][A-Za-z.'-]+)*),\s+(\d+\s+[A-Z][A-Za-z0-9.]+\s+\d+)", 1, 2)
BARE = Pattern("BARE", "", r"\bRule\s+(\d{1,4})" + SUBS, 1, 2)
SUFFIX = {"Civ": "FRCP", "App": "FRAP", "Evid": "FRE", "Crim": "FedR", "Bankr": "FedR"}
#: An explicit citation hides a bare one that starts at most this far behind it.
BARE_REACH = 64


def matches(text: Column, p: Pattern) -> Column:
    """array<struct<kind, system, number, path, surface, start, stop>> of all matches, offsets in code points.

    What lies between matches gives their places, so no pattern needs a Python function.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(p.regex), 0), F.split(text, p.regex, -1)
    number = F.regexp_extract_all(text, F.lit(p.regex), p.number)
    path = F.regexp_extract_all(text, F.lit(p.regex), p.path) if p.path else F.transform(found, lambda _: F.lit(""))
    which = F.regexp_extract_all(text, F.lit(p.regex), 1)
    zipped = F.arrays_zip(found.alias("m"), number.alias("n"), path.alias("p"), which.alias("w"), F.transform(gaps, F.length).alias("g"))
    kind = "struct<kind:string,system:string,number:string,path:string,surface:string,start:int,stop:int>"

    def system(w: Column) -> Column:
        if p.kind == "FEDR":
            return F.when(w == "Civ", "FRCP").when(w == "App", "FRAP").when(w == "Evid", "FRE").otherwise("FedR")
        if p.kind == "PROSE":
            return F.when(F.lower(w) == "evidence", "FRE").when(F.lower(w).startswith("civil"), "FRCP").otherwise("FRAP")
        return F.lit(p.system)

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["g"]
        end = begin + F.coalesce(F.length(x["m"]), F.lit(0))
        hit = F.struct(F.lit(p.kind).alias("kind"), system(x["w"]).alias("system"), x["n"].alias("number"), F.coalesce(x["p"], F.lit("")).alias("path"), x["m"].alias("surface"), begin.alias("start"), end.alias("stop"))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull(), F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(f"array<{kind}>")
    return F.when(text.rlike(p.regex), F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def citations(text: Column, patterns: tuple[Pattern, ...] = RULES + STATUTES + (CASE,)) -> Column:
    return F.flatten(F.array(*(matches(text, p) for p in patterns)))


def table_of(surface: Column) -> Column:
    """The table to which a surface that is a citation belongs: rules, statutes or cases; the first that fits."""
    out = F.when(F.lit(False), "")
    for p in RULES:
        out = out.when(surface.rlike(p.regex), "rules")
    for r in (STATUTES[0].regex, STATUTES[1].regex, r"\b\d+\s+U\.?\s*S\.?\s*C\.?\s"):
        out = out.when(surface.rlike(r), "statutes")
    return out.when(surface.rlike(r"^[A-Za-z][A-Za-z.'-]+\s+v\.\s+[A-Za-z]"), "cases")


def prose_to_rule(text: Column) -> Column:
    """A prose citation of a rule in its short form, else the text."""
    number = r"\s+(\d+(?:\.\d+)*(?:\([a-z0-9]+\))*)"
    forms = (
        (r"(?i)\bFederal\s+Rules?\s+of\s+Evidence" + number, "FRE"),
        (r"(?i)\bFederal\s+Rules?\s+of\s+Civil\s+Procedure" + number, "FRCP"),
        (r"(?i)\bFederal\s+Rules?\s+of\s+Appellate\s+Procedure" + number, "FRAP"),
        (r"(?i)\bModel\s+Rules?(?:\s+of\s+Professional\s+Conduct)?" + number, "MRPC"),
    )
    out = F.when(F.lit(False), "")
    for regex, system in forms:
        out = out.when(text.rlike(regex), F.concat(F.lit(f"{system} "), F.regexp_extract(text, regex, 1)))
    return out.otherwise(text)
