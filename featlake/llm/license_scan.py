"""License notices and texts in documents, by MinHash over overlapping windows.

Templates are partitioned by size: the span of one with n distinct shingles is
the least power of two (LEAST_SPAN at least) that n shingles in order fit in, and
a text is cut into windows of two spans, one each span, so that any run of a span
lies whole in a window. A template's signature is its k = n - ceil(0.8 n) + 1
least hashes, each a band of its own. A window that holds 0.8 of the template
lacks fewer than k of its shingles, so it shares a band with probability 1. A
window's signature is those of its hashes that may be bands: the shortest
templates, of which each hash is a band whatever its size, and the others are two
classes, and of each either the set of bands is looked at, if they are at most
SET_BANDS, or the greatest hash of a band is the bound. Windows are looked at
lazily, by a place in the text and the two windows that hold it. Equal bands retrieve (window, template) pairs, and the exact share of the whole
template's shingles in the window decides.

Defined cases: null and blank texts hold no notice; a text under five words is
one shingle; a document that repeats whole is scanned like one; rows of one id
with different texts are scanned each; a window at exactly the least share counts;
very long texts are read whole; templates without words are found nowhere;
columns besides id and text take no part, whatever their names; empty tables
give none.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decontaminate import least_shared
from .tables import broadcast_if_small, let, shingle_hashes, written

LEAST_SHARE, LEAST_SPAN = 0.8, 8
#: Bands of a class up to which their set is part of the expression.
SET_BANDS = 2000
#: Templates and candidates are broadcast up to this many rows of a few numbers.
TEMPLATE_ROWS, SMALL_ROWS = 1_000_000, 200_000

_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction"
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = (
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY'
    " AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL"
    " DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
    " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public license notices, and the texts of short licenses.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd-2-clause", _BSD_HEAD),
    ("bsd-2-clause-text", _BSD_HEAD + _BSD_TWO + _BSD_END),
    ("bsd-3-clause-text", _BSD_HEAD + _BSD_TWO + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission." + _BSD_END),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc-text", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("mit", "Released under the MIT License."),
    ("mit-grant", _MIT_GRANT),
    ("mit-text", _MIT_GRANT + ', including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
]


def license_words(text: Column) -> Column:
    """Runs of letters and digits in lower case: layout and punctuation of notices vary."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(text: Column) -> Column:
    return shingle_hashes(license_words(text))


def template_table(templates: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """A row per template (license, text) and shingle: ``license``, ``h``, ``n`` (its shingles), ``span`` and ``kept`` (whether the hash is in its signature)."""
    rows = templates.select("license", F.explode(_hashes(templates["text"])).alias("h")).distinct()
    own = W.partitionBy("license")
    rows = rows.withColumn("n", F.count("*").over(own)).withColumn("place", F.row_number().over(own.orderBy("h")))
    span = F.greatest(F.lit(LEAST_SPAN), F.pow(F.lit(2), F.ceil(F.log2("n")))).cast("int")
    return rows.select("license", "h", "n", span.alias("span"), (F.col("place") <= F.col("n") - least_shared(F.col("n"), least_share) + 1).alias("kept"))


def _windows(place: Column, span: Column) -> Column:
    """Starts of the windows that hold a place: each span a window of two spans begins."""
    last = (place - place % span).cast("int")
    return F.when(last > 0, F.array(last - span, last)).otherwise(F.array(last))


def may_be_band(table: DataFrame) -> Callable[[Column], Column]:
    """A condition on hashes that all bands fulfil, from the bands of either class."""
    tests = []
    for short in (F.col("span") <= LEAST_SPAN, F.col("span") > LEAST_SPAN):
        own = table.where("kept").where(short).select("h").distinct()
        few = [r["h"] for r in own.limit(SET_BANDS + 1).collect()]
        bound = own.agg(F.max("h")).first()[0] if len(few) > SET_BANDS else None
        if few:
            tests.append((lambda x, few=few: x.isin(few)) if bound is None else (lambda x, bound=bound: x <= F.lit(bound)))
    if not tests:
        return lambda x: F.lit(False)
    return lambda x: reduce(or_, [test(x) for test in tests])


def scanned(docs: DataFrame, key: str, text: str, templates: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """``doc_id``, ``row`` (hash of id and text), ``license``, ``start`` (first shingle of the window), ``n_template``, ``n_shared`` of every window that holds a template."""
    table = written(template_table(templates, least_share), "license-templates")
    bands = broadcast_if_small(table.where("kept").select("h", "license", "span"), TEMPLATE_ROWS)
    rows = docs.select(docs[key].alias("doc_id"), F.xxhash64(docs[key], docs[text]).alias("row"), docs[text].alias("text"))

    may = may_be_band(table)

    def places(hashes: Column) -> Column:
        """Hashes that may be bands, with their places."""
        return F.filter(F.transform(hashes, lambda x, i: F.struct(i.alias("p"), x.alias("h"))), lambda s: may(s["h"]))

    signed = rows.select("row", F.inline(let(_hashes(F.col("text")), places)))
    found = signed.join(bands, "h").select("row", "license", F.explode(_windows(F.col("p"), F.col("span"))).alias("start")).distinct()
    found = written(found, "license-candidates")
    wanted = broadcast_if_small(found.select("row").distinct(), SMALL_ROWS)
    again = rows.join(wanted, "row", "left_semi").select("doc_id", "row", F.posexplode(_hashes(F.col("text"))).alias("p", "h"))
    again = again.join(broadcast_if_small(table.drop("kept"), TEMPLATE_ROWS), "h")
    again = again.select("doc_id", "row", "license", "n", "h", F.explode(_windows(F.col("p"), F.col("span"))).alias("start")).distinct()
    exact = again.groupBy("doc_id", "row", "license", "n", "start").agg(F.count("*").alias("n_shared"))
    exact = exact.where(F.col("n_shared") >= least_shared(F.col("n"), least_share)).join(found, ["row", "license", "start"], "left_semi")
    return exact.select("doc_id", "row", "license", "start", F.col("n").alias("n_template"), "n_shared")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document, with the number of windows that hold one and the first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    templates = spark.createDataFrame(TEMPLATES, "license string, text string")
    hits = scanned(docs, "doc_id", "text", templates)
    return hits.groupBy("doc_id", "license").agg(F.count("*").alias("n_windows"), F.min("start").cast("long").alias("first_start"), F.max("n_shared").alias("n_shared"), F.max("n_template").alias("n_template"))


_ROWS = ",\n".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES)
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_SHINGLES = "select {id}, i - 1 as pos, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s from (select {id}, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from (select {id}, " + _WORDS + " as w from {table} where text is not null) where len(w) > 0)"
ORACLE_SQL = f"""
with t(license, text) as (values {_ROWS}),
ts as (select distinct license, s from ({_SHINGLES.format(id="license", table="t")})),
tn as (select license, count(*) as n_template, greatest({LEAST_SPAN}, cast(power(2, ceil(log2(count(*)))) as bigint)) as span from ts group by license),
ds as ({_SHINGLES.format(id="doc_id", table="documents")}),
hit as (select doc_id, pos, license, span, s from ds join ts using (s) join tn using (license)),
win as (select doc_id, license, unnest([pos // span, pos // span - 1]) * span as start, s from hit),
c as (select doc_id, license, start, count(distinct s) as n_shared from win where start >= 0 group by all)
select doc_id, license, count(*) as n_windows, min(start) as first_start, max(n_shared) as n_shared, max(n_template) as n_template
from c join tn using (license) where n_shared >= {LEAST_SHARE} * n_template group by doc_id, license
"""
