"""Licence scan in DataFrame functions: TF-IDF cosine to templates, then inheritance along paths.

Every line of a file, every few adjacent lines (a notice may be wrapped) and the file as a whole
are compared with licence notices by the cosine of sparse TF-IDF vectors. The file as a whole is
also compared with full licence texts and header paragraphs, where a word counts by 1 + log of
its number, so that a few frequent words are no licence. Inverse document
frequencies come from all files, for the words of the templates; a word of no template is as
rare as can be and counts in the length of a vector only. A file without a licence of its own
takes that of the nearest directory above it that holds a licence file: one with such a name
whose whole text fits a template.

What is found in a file depends on its text alone, so findings are kept per text and joined back to
every row by its digest; files that share a path, or have none, do not share findings.

Not every line need be weighed: by Cauchy-Schwarz a line that shares only words whose weights in
a template have a norm below the threshold cannot reach it, so a line must hold one of the
other words. For full texts the words that a file shares must have a norm of the threshold
together, bounded from above by tiers of weights. Both filters are exact.
"""

import json
import math
import re
from collections import Counter
from collections.abc import Callable
from functools import cache, reduce
from importlib.resources import files as resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmart.llm.common import lower_ascii
from tillmart.operators.staging import stage

THRESHOLD = 0.6
#: The short notices by which files name their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Header paragraphs; with the files of license_texts/ (of CC-BY-NC-4.0 the main clauses) they are what whole files are compared with.
HEADERS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "CC-BY-NC-4.0": """This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of
        this license, visit http://creativecommons.org/licenses/by-nc/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA.""",
}
#: How names of licence files begin, in any case.
LICENSE_FILE = r"(?i)^(licen[cs]es?|copying|copyright|notice|unlicense)([._-].*)?$"
#: Adjacent lines weighed together at most, as a notice of some 15 words is wrapped.
WRAPPED_LINES = 3
_WHOLE = -1


@cache
def full_texts() -> dict[str, list[str]]:
    """Per licence its full text and, where it has one, its header paragraph."""
    folder = resources("tillmart.llm").joinpath("license_texts")
    return {name: [folder.joinpath(f"{name}.txt").read_text("utf-8"), *filter(None, [HEADERS.get(name)])] for name in TEMPLATES}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda found: found[0].lower(), text))


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), "[^a-z0-9]+"), lambda word: word != "")


def directory_of(path: Column) -> Column:
    """The path without its last part; '' is the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def clean_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), "/+", "/"), "^/", "")


def rarity(total: int, found: int) -> float:
    return math.log((1 + total) / (1 + found)) + 1


def weigh(
    templates: dict[str, str], total: int, found: dict[str, int], times: Callable[[int], float] = float
) -> tuple[dict[str, float], dict[str, dict[str, float]]]:
    """The rarity of each template word, and each template as a vector of length 1; times is the weight of a word's number."""
    counts = {name: Counter(words_of(text)) for name, text in templates.items()}
    rare = {word: rarity(total, found.get(word, 0)) for word in {word for some in counts.values() for word in some}}
    vectors = {}
    for name, some in counts.items():
        vector = {word: times(n) * rare[word] for word, n in some.items()}
        length = math.sqrt(sum(weight**2 for weight in vector.values()))
        vectors[name] = {word: weight / length for word, weight in vector.items()}
    return rare, vectors


def may_reach(held: Column, vectors: dict[str, dict[str, float]], threshold: float) -> Column:
    """Whether the distinct words of a file may suffice for the threshold with a vector: their norm in it, each weight rounded up to its tier's largest."""
    least, square = [], threshold**2 - 1e-9
    bounds = []
    for vector in vectors.values():
        heavy = sorted(((weight**2, word) for word, weight in vector.items()), reverse=True)
        total = 0.0
        for n, (weight, _) in enumerate(heavy):
            total += weight
            if total >= square or n + 1 == len(heavy):
                least.append(n + 1)
                break
        tiers: dict[int, list[tuple[float, str]]] = {}
        for weight, word in heavy:
            tiers.setdefault(min(8, int(2 * math.log2(heavy[0][0] / weight))), []).append((weight, word))
        bounds.append([(some[0][0], [word for _, word in some]) for some in tiers.values()])

    def judge(words: Column) -> Column:
        fits = F.lit(False)
        for tiers in bounds:
            fits = fits | (sum((F.size(F.array_intersect(words, F.array(*map(F.lit, some)))) * F.lit(top) for top, some in tiers), F.lit(0.0)) >= square)
        return (F.size(words) >= min(least)) & fits

    return F.exists(F.array(held), judge)  # the words are named once, as the argument of a lambda


def anchors(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Words of which a text must hold one to reach the threshold with any template."""
    needed = set()
    for vector in vectors.values():
        square = 0.0
        for word, weight in sorted(vector.items(), key=lambda entry: (entry[1], entry[0])):
            square += weight**2
            if math.sqrt(square) >= threshold - 1e-9:
                needed.add(word)
    return sorted(needed)


def scan_licenses(
    files: DataFrame, id_col: str, path_col: str, text_col: str, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
    texts: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per row of files: id, path, own_license, own_score, own_line, license, inherited_from.

    own_line counts from 0, is the first of adjacent lines, and is -1 where the file as a whole fits
    best. license is the file's own or else the inherited one, with the directory it comes from (''
    is the root). Equal scores: the file as a whole, then the earlier line, then fewer lines, then
    notices before full texts, then the template first by name; of licence files in one directory the
    one with the higher score, then the first path, then the licence first by name. Rows that repeat
    a path keep findings of their own. A null path is the root's file '', which is no licence file; a
    null or empty text has no licence of its own, an empty table gives an empty result, and other
    columns play no part.
    """
    texts = texts if texts is not None else {} if templates else full_texts()
    templates = templates or TEMPLATES
    long = {f"{name}\0{n}": text for name, some in sorted(texts.items()) for n, text in enumerate(some)}
    text = F.coalesce(F.col(text_col), F.lit(""))
    files = files.select(F.col(id_col).alias("id"), clean_path(F.col(path_col)).alias("path"), text.alias("text"), _digest(text).alias("digest"))
    vocabulary = sorted({word for template in [*templates.values(), *long.values()] for word in words_of(template)})

    held = F.array_intersect(_words(F.col("text")), F.array(*map(F.lit, vocabulary)))
    counts = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = {row.word: row["count"] for row in counts.collect()}  # a row per template word, and '' for all files
    total = found.pop("", 0)
    rare, vectors = weigh(templates, total, found)

    must, may = _one_of(anchors(vectors, threshold)), _one_of(sorted(rare))
    whole = files.select(F.monotonically_increasing_id().alias("row"), "digest", lower_ascii(F.col("text")).alias("text")).where(F.col("text").rlike(must))
    whole = whole.select("row", "digest", F.explode(_units(F.col("text"), must, may)).alias("u"))
    words = whole.select("row", "digest", "u.pos", "u.lines", F.explode(_words(F.col("u.unit"))).alias("word"))
    units = _fits(words, rare, vectors, rarity(total, 0), threshold)
    if long:
        rare, vectors = weigh(long, total, found, lambda n: 1 + math.log(n))
        near = files.select(F.monotonically_increasing_id().alias("row"), "digest", "text").where(may_reach(held, vectors, threshold))
        words = near.select("row", "digest", F.lit(_WHOLE).alias("pos"), F.lit(0).alias("lines"), F.explode(_words(F.col("text"))).alias("word"))
        more = _fits(words, rare, vectors, rarity(total, 0), threshold, lambda n: F.lit(1.0) + F.log(n), len(templates))
        units = units.unionByName(more)
    own = stage(_best_fit(units), "own-licenses")
    return _inherit(files.select("id", "path", "digest"), own).select(
        F.col("id").alias(id_col), "path", "own_license", "own_score", "own_line", "license", "inherited_from"
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _one_of(words: list[str]) -> str:
    """A pattern of texts in lower case that hold one of the words."""
    return "(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])"


def _units(text: Column, must: str, may: str) -> Column:
    """(pos, lines, unit): the whole text, and every one to WRAPPED_LINES adjacent lines that hold a needed word, the first and the last some template's.

    A line at an end without a word of any template only lowers the cosine, so no best run is left out.
    """

    def runs(lines: Column) -> Column:
        def run(size: int) -> Column:
            starts = F.when(F.size(lines) >= size, F.sequence(F.lit(0), F.size(lines) - size)).otherwise(F.array().cast("array<int>"))

            def fits(n: Column) -> Column:
                needed = reduce(Column.__or__, [F.get(lines, n + step)["must"] for step in range(size)])
                return needed & F.get(lines, n)["may"] & F.get(lines, n + size - 1)["may"]

            unit = lambda n: F.array_join(F.transform(F.slice(lines, n + 1, size), lambda line: line["line"]), " ")
            return F.transform(F.filter(starts, fits), lambda n: F.struct(n.alias("pos"), F.lit(size).alias("lines"), unit(n).alias("unit")))

        return F.concat(*(run(size) for size in range(1, WRAPPED_LINES + 1)))

    marked = F.transform(F.split(text, "\n", -1), lambda line: F.struct(line.alias("line"), line.rlike(must).alias("must"), line.rlike(may).alias("may")))
    named = F.transform(F.array(marked), runs)  # the lines are named once, as the argument of a lambda
    return F.concat(F.array(F.struct(F.lit(_WHOLE).alias("pos"), F.lit(0).alias("lines"), text.alias("unit"))), F.get(named, F.lit(0)))


def _fits(
    words: DataFrame, rare: dict[str, float], vectors: dict[str, dict[str, float]], unknown: float, threshold: float,
    times: Callable[[Column], Column] = lambda n: n, behind: int = 0,
) -> DataFrame:
    """The units that reach the threshold: digest, pos, lines, best (score, first, name). `behind` templates go before these where scores are equal."""
    names = sorted(vectors)
    weights = [{"word": word, "rare": rare[word]} | {f"t{n}": vectors[name].get(word, 0.0) for n, name in enumerate(names)} for word in sorted(rare)]
    kind = "word string, rare double, " + ", ".join(f"t{n} double" for n in range(len(names)))
    known = words.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(weights)), f"array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>")))
    counted = words.groupBy("row", "digest", "pos", "lines", "word").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(F.broadcast(known), "word", "left")  # one row per template word
    weight = times(F.col("n")) * F.coalesce("rare", F.lit(unknown))
    dots = [F.sum(weight * F.col(f"t{n}")).alias(f"d{n}") for n in range(len(names))]
    units = counted.groupBy("row", "digest", "pos", "lines").agg(F.sqrt(F.sum(weight * weight)).alias("length"), *dots)
    # Rounded, so that the order in which sums are formed decides no tie.
    scores = F.array(*(F.struct(F.round(F.coalesce(F.col(f"d{n}"), F.lit(0.0)) / F.col("length"), 9).alias("score"), F.lit(-n - behind).alias("first"), F.lit(name.partition("\0")[0]).alias("name")) for n, name in enumerate(names)))
    return units.select("digest", "pos", "lines", F.array_max(scores).alias("best")).where(F.col("best.score") >= threshold)


def _best_fit(units: DataFrame) -> DataFrame:
    """Per text the best template of its lines and of the whole: digest, own_license, own_score, own_line, file_license, file_score."""
    order = F.struct(
        F.col("best.score").alias("score"), (-F.col("pos")).alias("place"), (-F.col("lines")).alias("fewer"), F.col("best.first").alias("first"), F.col("best.name").alias("name")
    )
    best = units.groupBy("digest").agg(F.max(order).alias("own"), F.max(F.when(F.col("pos") == _WHOLE, order)).alias("file"))
    return best.select(
        "digest", F.col("own.name").alias("own_license"), F.col("own.score").alias("own_score"), (-F.col("own.place")).alias("own_line"),
        F.col("file.name").alias("file_license"), F.col("file.score").alias("file_score"),
    )


def _inherit(files: DataFrame, own: DataFrame) -> DataFrame:
    """Joins each directory, not each file, with the directories above it that hold a licence file."""
    named = files.where(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE)).select("path", "digest")
    best = F.min(F.struct((-F.col("file_score")).alias("less"), "path", "file_license"))
    holders = named.join(own.where("file_license IS NOT NULL"), "digest").groupBy(directory_of(F.col("path")).alias("directory")).agg(best.alias("best"))
    holders = holders.select("directory", "best.file_license")

    parts = F.split("directory", "/", -1)
    above = F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    )
    directories = files.select(directory_of(F.col("path")).alias("directory")).distinct()
    reached = directories.select(F.col("directory").alias("below"), F.posexplode(above).alias("depth", "directory")).join(holders, "directory")
    nearest = reached.groupBy("below").agg(F.max(F.struct("depth", F.col("directory").alias("holder"), "file_license")).alias("nearest"))
    nearest = nearest.select(F.col("below").alias("directory"), "nearest.holder", "nearest.file_license")

    rows = files.join(own.select("digest", "own_license", "own_score", "own_line"), "digest", "left").withColumn("directory", directory_of(F.col("path")))
    rows = rows.join(nearest, "directory", "left")
    bare = F.col("own_license").isNull()
    return rows.select(
        "id", "path", "own_license", "own_score", "own_line", F.coalesce("own_license", "file_license").alias("license"),
        F.when(bare, F.col("holder")).alias("inherited_from"),
    )
