"""License scans: canonical digest lookup. Texts are normalised with built-in functions (case,
copyright lines, punctuation, equivalent spellings) and whole texts are hash-joined to the digests
of known licences, which go through the same normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, whole_texts
from .license_texts import KNOWN

# A copyright line names a year, (c), © or a placeholder; a line that only begins with the word by its wrapping
# or with "(c)" as the mark of a clause stays.
COPYRIGHT_LINE = (r"(^|\n)[ \t/*#-]*(copyright([ \t:]*(\(c\)|©|[<{\[])|[^\n]*(19|20)[0-9][0-9])"
                  r"|(\(c\)|©)[ \t]*((19|20)[0-9][0-9]|[<{\[]|copyright))[^\n]*")
# A notice still to be filled in ends with its last placeholder, wherever it stands and however it is wrapped.
OPEN_NOTICE = r"copyright[ \t:]*(\(c\)|©)?([ \t\r\n,/*#-]*(<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}))+"
# ASCII punctuation, control characters and blanks, and the usual typographic marks
PUNCTUATION = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f ©‐-―‘-‟•]+"
# Equivalent spellings, left form to right form (published matching guidelines).
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"),
    ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"), ("utilisation", "utilization"),
    ("whilst", "while"), ("wilful", "willful"), ("non commercial", "noncommercial"), ("copyright holders", "copyright holder"),
    ("copyright owners", "copyright holder"),
]
# Fixed value: a phrase of copyright notices, wherever it stands.
LEFT_OUT = "all rights reserved"


def canonical(text: Column) -> Column:
    """Normalised text: words joined by two spaces with two at either end, so that neighbouring
    words never share a separator; blank texts become blanks alone."""
    x = F.regexp_replace(F.regexp_replace(ascii_lower(text), OPEN_NOTICE, " "), COPYRIGHT_LINE, "\n")
    x = F.concat(F.lit(" "), F.regexp_replace(x, PUNCTUATION, "  "), F.lit(" "))
    x = F.concat(F.lit("  "), F.trim(x), F.lit("  "))
    x = F.replace(x, F.lit("  " + LEFT_OUT.replace(" ", "  ") + "  "), F.lit("  "))
    for a, b in EQUIVALENT:
        x = F.replace(x, F.lit(" " + a.replace(" ", "  ") + " "), F.lit(" " + b.replace(" ", "  ") + " "))
    return x


def known_licenses(spark) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, license_text string")


def scan_licenses(docs: DataFrame, licenses: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license_id (null where the whole text is no known licence).

    ``licenses``: license_id, license_text. Licences with the same canonical text count as the one
    of least id; blank or null licence texts are left out. A text may be wrapped at any width; only a line that
    holds a copyright notice ends the notice with its end. Texts of any length are normalised whole. Null texts
    count as empty and match nothing; repeated rows stay; a null doc_id stays null; an empty table gives no row. The
    licences are joined by digest: Spark broadcasts them when they are small enough and shuffles
    otherwise, where adaptive execution splits a digest that very many documents share."""
    known = (licenses.select("license_id", F.trim(canonical(F.coalesce("license_text", F.lit("")))).alias("c")).filter("c <> ''")
             .groupBy(F.sha2("c", 256).alias("canonical_sha256")).agg(F.min("license_id").alias("license_id")))
    texts = whole_texts(docs, id_col, text_col).select("doc_id", F.sha2(F.trim(canonical(F.col("text"))), 256).alias("canonical_sha256"))
    return texts.join(known, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _canonical_sql(col: str) -> str:
    x = f"translate({col}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    x = f"regexp_replace({x}, {_literal(OPEN_NOTICE)}, ' ', 'g')"
    x = f"regexp_replace({x}, {_literal(COPYRIGHT_LINE)}, chr(10), 'g')"
    x = f"'  ' || trim(regexp_replace({x}, {_literal(PUNCTUATION)}, '  ', 'g')) || '  '"
    x = f"replace({x}, '  {LEFT_OUT.replace(' ', '  ')}  ', '  ')"
    for a, b in EQUIVALENT:
        x = f"replace({x}, '{' ' + a.replace(' ', '  ') + ' '}', '{' ' + b.replace(' ', '  ') + ' '}')"
    return f"sha256(trim({x}))"


def oracle() -> str:
    values = ", ".join(f"({_literal(i)}, {_literal(t)})" for i, t in KNOWN)
    return f"""
WITH known AS (SELECT {_canonical_sql('license_text')} AS canonical_sha256, min(license_id) AS license_id
  FROM (VALUES {values}) v(license_id, license_text) GROUP BY 1)
SELECT d.doc_id, d.canonical_sha256, k.license_id
FROM (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS canonical_sha256 FROM documents) d LEFT JOIN known k USING (canonical_sha256)
"""
