"""Licence scan by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright lines dropped, runs of
anything but letters and digits to one space, equivalent spellings to one. The
SHA-256 of the whole canonical text is hash-joined to the digests of known licences:
those of the texts in license_texts and of the whole long licences in license_digests.
A copyright line starts with the word or the sign and names a year or a placeholder, or a
name (`Copyright Foo Inc.`): the word in lower case but for its first letter, then a capital
that doesn't begin a term of licences such as `Copyright Holder`. A sentence of a licence
that is wrapped before the word `copyright` stays. A title above the first words of a short
licence (`The MIT License (MIT)`, `BSD 3-Clause License`) is dropped. Whoever a BSD licence
names (`Neither the name of Foo Inc. nor ...`, `provided by the regents ...`) stands for
the holder, in up to NAMED words.

Every word is respelt by itself, neighbours included; spellings are looked for only in
texts that hold one, which changes nothing else. Nulls: a null text has null digest and
matches nothing; a text without letters or digits has the digest of the empty string and
matches nothing. Very long texts are taken whole. Ties: two known texts with one digest
give the identifiers joined by `/`, in code point order. Empty tables give empty
results, repeated rows repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table
from quarry.llm.license_digests import DIGESTS
from quarry.llm.license_texts import KNOWN

#: (spelling, canonical one), of whole words after punctuation is gone.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("licencee", "licensee"),
    ("licencees", "licensees"),
    ("licencing", "licensing"),
    ("licencor", "licensor"),
    ("licencors", "licensors"),
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("owner", "holder"),
    ("owners", "holders"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("sublicences", "sublicenses"),
    ("sublicenced", "sublicensed"),
    ("sublicencing", "sublicensing"),
    ("relicencing", "relicensing"),
    ("unlicenced", "unlicensed"),
    ("utilisation", "utilization"),
    ("while", "whilst"),
    ("wilful", "willful"),
    ("https", "http"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z\n]*(?:(?:copyright|\(c\)|©)(?:[^\n]*[0-9]{4}|[ \t:]*(?:\(c\)|©|[<\[{]|by ))|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


#: Terms of licences that follow the word, so that such a line names nobody.
TERMS = ("Act", "Acts", "Holder", "Holders", "Interest", "Law", "Laws", "Licence", "License", "Notice", "Notices", "Owner", "Owners", "Statement")
NAMED_LINE = r"(?m)^[^A-Za-z\n]*[Cc]opyright[ \t:]+\p{Lu}[^\n]*$"
#: Words of a holder's name at most.
NAMED = 30
#: (pattern, its start, its end): what stands between is replaced by HOLDER words. Of canonical texts.
SLOTS = (
    (rf"neither the names? of (?:[^ ]+ ){{1,{NAMED}}}?nor the names of its contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (rf"this software is provided by (?:[^ ]+ ){{1,{NAMED}}}?as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
    (rf"in no event shall (?:[^ ]+ ){{1,{NAMED}}}?be liable for any direct", "in no event shall the copyright holder or contributors be liable for any direct"),
)
#: A title and the first words of a licence that may bear it. Of canonical texts.
TITLE = r"^(?:the )?(?:(?:mit|isc|zlib|expat|x11)(?: license)?(?: mit| isc)?|mit no attribution(?: license)?|(?:new |modified |revised |simplified )?bsd(?: [023] clause)?(?: license)?|[023] clause bsd license|bsd zero clause license|zero clause bsd(?: license)?) "
FIRST_WORDS = "(permission is hereby granted|permission to use copy modify|redistribution and use in source|this software is provided as is)"


def canonical(text: Column) -> Column:
    terms = text
    for term in TERMS:
        terms = F.replace(terms, F.lit(f"Copyright {term}"), F.lit(f"copyright {term.lower()}"))
    unnamed = F.when(text.contains("opyright"), F.regexp_replace(terms, NAMED_LINE, " ")).otherwise(text)
    low = F.lower(unnamed)
    low = F.when(low.rlike(r"copyright|\(c\)|©|all rights reserved"), F.regexp_replace(low, COPYRIGHT_LINE, " ")).otherwise(low)
    plain = F.regexp_replace(low, NOT_WORD, " ")
    # two spaces between words, so that no two spellings share one
    respelt = F.concat(F.lit(" "), F.replace(plain, F.lit(" "), F.lit("  ")), F.lit(" "))
    for spelling, one in SPELLINGS:
        respelt = F.replace(respelt, F.lit(" " + spelling.replace(" ", "  ") + " "), F.lit(f" {one} "))
    any_of = r" (?:" + "|".join(spelling for spelling, _ in SPELLINGS) + r") "
    holds = F.concat(F.lit(" "), plain, F.lit(" ")).rlike(any_of)
    out = F.trim(F.when(holds, F.replace(respelt, F.lit("  "), F.lit(" "))).otherwise(plain))
    slotted = out
    for pattern, whole in SLOTS:
        slotted = F.regexp_replace(slotted, pattern, whole)
    out = F.when(out.contains("redistribution and use in source"), slotted).otherwise(out)
    return F.regexp_replace(out, TITLE + FIRST_WORDS, "$1")


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] = KNOWN, digests: Sequence[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(digest, license_id) of the known texts and digests; no more rows than are given."""
    rows = spark.createDataFrame(list(known), "license_id string, text string").select("license_id", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    rows = rows.unionByName(spark.createDataFrame(list(digests), "license_id string, digest string"))
    return rows.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license_id")), "/").alias("license_id"))


def license_scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, canonical_sha256, license_id) for every row of docs; known: (digest, license_id), one row a digest."""
    digests = docs.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("_digest"))
    # exploded, so that a filter above stays above: it would make the digest once more, without sharing what its expression repeats
    digests = digests.select("doc_id", F.explode(F.array("_digest")).alias("canonical_sha256"))
    return digests.join(known.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")


def op1_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the known texts are those of one module of this package
    return license_scan(table(spark, sf_dir, "documents", "doc_id", "text"), F.broadcast(known_digests(spark)))


def noisy(text: Column, k: int) -> Column:
    """The text with noise that the canonical form drops."""
    respelt = F.replace(F.replace(text, F.lit("License"), F.lit("Licence")), F.lit("copyright holder"), F.lit("copyright  owner"))
    return (text, F.upper(text), F.concat(F.lit("Copyright (c) 2020 One\n(c) 2021-2024 Two\n\n"), text), F.concat(F.lit("** "), F.replace(respelt, F.lit(", "), F.lit(" ; ")), F.lit(" **")))[k]


NOISES = 4


def license_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known texts with noise among all documents: what is found."""
    known = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(KNOWN)], "i long, text string")
    planted = [known.select((-1 - F.col("i") - len(KNOWN) * k).alias("doc_id"), noisy(F.col("text"), k).alias("text")) for k in range(NOISES)]
    docs = reduce(DataFrame.unionByName, planted, table(spark, sf_dir, "documents", "doc_id", "text"))
    # as in op1, as many rows as texts and digests are given
    return license_scan(docs, F.broadcast(known_digests(spark))).where("license_id IS NOT NULL").select("doc_id", "license_id")


def _chain(text: str) -> str:
    terms = text
    for term in TERMS:
        terms = f"replace({terms}, 'Copyright {term}', 'copyright {term.lower()}')"
    low = f"lower(regexp_replace({terms}, '{NAMED_LINE}', ' ', 'g'))"
    low = f"regexp_replace({low}, '{COPYRIGHT_LINE}', ' ', 'g')"
    out = f"' ' || replace(regexp_replace({low}, '{NOT_WORD}', ' ', 'g'), ' ', '  ') || ' '"
    for a, b in SPELLINGS:
        out = f"replace({out}, ' {a.replace(' ', '  ')} ', ' {b} ')"
    out = f"trim(replace({out}, '  ', ' '))"
    slotted = out
    for pattern, whole in SLOTS:
        slotted = f"regexp_replace({slotted}, '{pattern}', '{whole}', 'g')"
    out = f"CASE WHEN contains({out}, 'redistribution and use in source') THEN {slotted} ELSE {out} END"
    return f"sha256(regexp_replace({out}, '{TITLE}{FIRST_WORDS}', '\\1'))"


def _known() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    given = ", ".join(f"('{i}', '{d}')" for i, d in DIGESTS)
    return f"""t AS (SELECT row_number() OVER () - 1 AS i, id, t FROM (VALUES {values}) v(id, t)),
k AS (SELECT digest, string_agg(id, '/' ORDER BY id) AS license_id FROM (SELECT id, {_chain("t")} AS digest FROM t UNION SELECT * FROM (VALUES {given}) g(id, digest)) GROUP BY digest)"""


def _oracle() -> str:
    return f"WITH {_known()} SELECT doc_id, canonical_sha256, license_id FROM (SELECT doc_id, {_chain('text')} AS canonical_sha256 FROM documents) LEFT JOIN k ON canonical_sha256 = digest"


def _variants_oracle() -> str:
    n = len(KNOWN)
    return f"""WITH {_known()},
d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - i, t FROM t UNION ALL SELECT -1 - i - {n}, upper(t) FROM t
  UNION ALL SELECT -1 - i - {2 * n}, 'Copyright (c) 2020 One' || chr(10) || '(c) 2021-2024 Two' || chr(10) || chr(10) || t FROM t
  UNION ALL SELECT -1 - i - {3 * n}, '** ' || replace(replace(replace(t, 'License', 'Licence'), 'copyright holder', 'copyright  owner'), ', ', ' ; ') || ' **' FROM t)
SELECT doc_id, license_id FROM (SELECT doc_id, {_chain("text")} AS digest FROM d) JOIN k USING (digest)"""


QUERIES = {"op1_license_digests": op1_license_digests, "license_variants": license_variants}
ORACLES = {"op1_license_digests": _oracle(), "license_variants": _variants_oracle()}
