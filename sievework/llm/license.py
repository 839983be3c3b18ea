"""Licence scan: a canonical form of a whole text is hashed and joined to known licence digests (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

# Words that count as equal (variant, canonical).
EQUIVALENTS = (
    ("acknowledgement", "acknowledgment"), ("acknowledgements", "acknowledgments"), ("analogue", "analog"), ("artefact", "artifact"),
    ("artefacts", "artifacts"), ("authorisation", "authorization"), ("authorise", "authorize"), ("authorised", "authorized"),
    ("behaviour", "behavior"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"),
    ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("holder", "owner"),
    ("holders", "owners"), ("honour", "honor"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"),
    ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"), ("organisation", "organization"), ("organisations", "organizations"), ("practise", "practice"),
    ("programme", "program"), ("recognise", "recognize"), ("recognised", "recognized"), ("sublicence", "sublicense"),
    ("utilisation", "utilization"), ("utilise", "utilize"), ("whilst", "while"), ("wilful", "willful"),
)
# Pairs of words that count as one.
PAIRS = (("per cent", "percent"), ("sub license", "sublicense"))

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

# Fixed values: (licence, its usual title, its text) of short public licences.
SHORT = (
    ("0BSD", "BSD Zero Clause License", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_ISC}"),
    ("BSD-2-Clause", "BSD 2-Clause License", f"{_BSD1}\n\n{_BSD2}\n\n{_BSD}"),
    ("BSD-3-Clause", "BSD 3-Clause License", f"{_BSD1}\n\n{_BSD2}\n{_BSD3}\n\n{_BSD}"),
    ("ISC", "ISC License", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC}"),
    ("MIT", "MIT License", f"{_MIT}\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_WARRANTY}"),
    ("MIT-0", "MIT No Attribution", f"{_MIT.replace(', subject to the following conditions:', '.')}\n\n{_WARRANTY}"),
    ("Zlib", "zlib License", _ZLIB),
)


def _forms(short: str, title: str, text: str) -> list[str]:
    """The usual files of a short licence: with and without its title and short name, a reservation of rights, and list marks of any kind."""
    starts = [""] + [f"{the}{title}{name}\n\n" for name in ("", f" ({short})") for the in ("", "The ")]
    marks = [lambda m: m[0], lambda m: "* ", lambda m: f"({chr(96 + int(m[1]))}) "]
    bodies = [re.sub(r"(?m)^([0-9])\. ", mark, text) for mark in marks]
    return list(dict.fromkeys(start + rights + body for rights in ("", "All rights reserved.\n\n") for body in bodies for start in starts))


#: (licence, whole text) of all forms of short licences.
KNOWN = tuple((i, form) for i, title, text in SHORT for form in _forms(i, title, text))
# Digests of the canonical forms of longer public licences (licence, SHA-256).
DIGESTS = (
    ("Apache-2.0", "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("BSL-1.0", "7442addb08927564a6aefb68009afaa4aadf14d9dc8faaae9539cd1b14a7e5e5"),
    ("CC-BY-SA-4.0", "951b08fc8d8e001ae4b49d025a15515b375c7d07d83aea8d9e72eb4745da9849"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "66919c3537107c2c9f5219f6ba4c41fe9c0d7c14d885087e3db69494463a778e"),
    ("GFDL-1.3", "525fd4384869c81c4cbd264822942ae15202284aed28fb120ba01fc119dda9ff"),
    ("GPL-1.0", "b31eae78d3d9d7759fae54ded3670392c42887bb3764639a66ad75d4aa31c241"),
    ("GPL-2.0", "53800f3eaa9b2c5a9e0bdbc62d06eaa72242dac318a0d8ebe22623eee4657680"),
    ("GPL-2.0", "c8597fbb7a6da7774352c40caa967250f0b0fc6ea1b73c052ac49fe405087c0a"),
    ("GPL-3.0", "9c2177600ce7fa6a1494b35db295201ce27658de03561bb0b28dba831fdf77ff"),
    ("LGPL-2.0", "cd4c44464175b9bdb18886dd2396372c4573def44d864d831249c625f52238d1"),
    ("LGPL-2.1", "0e8046ce7f9eec5420003481be92280a0b9d44a1ff6aff0dcabf8c78f88a35b9"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "2ba12a88a5f6fb9b1ecfbaa49f5a9f4d0bbcf278b485d37111c51d8615d21846"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("NCSA", "2ad8f6130122c81134816d3c2382f6acbf3405b4a64d5dc8ae203a77c5f31585"),
    ("OFL-1.1", "2d402e158d9c56bd10c82cf3dff848c1a5789613b6249cf2a6090dbc89516498"),
    ("Unicode-3.0", "0dcb83b35ff414a568168e367017e97091ab27bd1899132f3bfc8db32bfec447"),
    ("Unlicense", "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd"),
    ("WTFPL", "067bdb797cf86dc4a0b000155ee79caac0a641773169d0b45f2c7e2d1c0e6b79"),
)

# The usual names of licences.
NAMES = (
    ("0BSD", ("BSD Zero Clause License", "0BSD")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL, version 3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache 2")),
    ("Artistic-2.0", ("Artistic License 2.0", "Artistic-2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "BSD-2-Clause")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-clause BSD license", "New BSD License", "Modified BSD License", "BSD-3-Clause")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0")),
    ("CC-BY-4.0", ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0 license")),
    ("CC-BY-NC-4.0", ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0 license")),
    ("CC-BY-NC-ND-4.0", ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0")),
    ("CC-BY-NC-SA-4.0", ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0")),
    ("CC-BY-ND-4.0", ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0")),
    ("CC-BY-SA-4.0", ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0 license")),
    ("CC0-1.0", ("CC0 1.0 Universal", "CC0 1.0", "CC0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "Eclipse Public License v. 2.0", "EPL-2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL, version 2", "GPL version 2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL, version 3", "GPL version 3", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3")),
    ("ISC", ("ISC License", "ISC")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPLv2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv3")),
    ("MIT", ("MIT License", "MIT")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0")),
    ("OFL-1.1", ("SIL Open Font License, Version 1.1", "SIL Open Font License 1.1", "OFL-1.1")),
    ("PSF-2.0", ("Python Software Foundation License", "PSF License", "PSF-2.0")),
    ("Unlicense", ("Unlicense", "The Unlicense")),
    ("Zlib", ("zlib License", "Zlib")),
)
# The ways in which a line declares a licence.
FORMS = ("SPDX-License-Identifier: {}", "License: {}") + tuple(
    f"{subject}{verb} under {article}{{}}{rest}"
    for subject in ("", "This work is ", "This project is ", "This software is ", "This program is ", "This code is ", "This file is ", "This library is ")
    for verb in ("licensed", "released", "distributed", "available")
    for article in ("", "the ", "a ", "the terms of the ")
    for rest in ("", " (the \"License\")")
)
NOTICES = tuple((i, form.replace("{}", name)) for i, names in NAMES for name in names for form in FORMS)
_DECLARES = r"(?i)licen[cs]ed?|released under|distributed under|available under"
# A copyright notice goes to the end of its line, or to the words with which a licence begins. A line that begins with the
# holder and ends with a year is one as well.
COPYRIGHT = (
    r"(?m)(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|[\[{<](?:yyyy|year)[\]}>])|\(c\)[ \t]*(?:copyright[ \t]*)?[0-9]{4}|©)[^\n]*?"
    r"(permission is hereby|permission to use|redistribution and use|licensed under|(?:this|the) (?:software|program|library|work|file|code|project) is|$)"
    r"|^[^\p{L}\p{N}\n]*copyright[ \t,:]+[^\n]{1,80}[ \t,(](?:19|20)[0-9]{2}(?:[ \t]*[-,][ \t]*(?:19|20)[0-9]{2})*[).]?(?:[ \t]+all rights reserved\.?)?[ \t\r]*$"
)
# What follows the licence's name in a line of a README: where to read it. Applied to a canonical line.
POINTER = r" see (the )?(file )?license( .*)?$| see (the )?(file )?copying( .*)?$"


def canonical(text: Column) -> Column:
    """Lower case; no copyright notices; runs of anything but letters and digits become one blank; one spelling a word."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, "$1"), r"[^\p{L}\p{N}]+", " "))
    usual = F.create_map(*[F.lit(x) for pair in EQUIVALENTS for x in pair])
    spelt = F.array_join(F.transform(F.split(plain, " "), lambda w: F.when(w.isin([v for v, _ in EQUIVALENTS]), usual[w]).otherwise(w)), " ")
    for pair, one in PAIRS:
        spelt = F.regexp_replace(spelt, f"(^| ){pair}( |$)", f"$1{one}$2")
    return spelt


def digests(spark: SparkSession, known=KNOWN, ready=()) -> DataFrame:
    """(digest, license_id) of (license_id, text) pairs and of ready (license_id, digest) pairs; of equal digests the least id stays."""
    rows = spark.createDataFrame(list(known), "license_id string, text string").select(F.sha2(canonical(F.col("text")), 256).alias("digest"), "license_id")
    rows = rows.unionByName(spark.createDataFrame(list(ready), "license_id string, digest string")) if ready else rows
    return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def digests_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(digest, license_id) of the licence texts in a folder, one text a file, named by the file without its ending: a table for scan."""
    files = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(F.substring_index(F.input_file_name(), "/", -1), r"[.]txt$", "")
    return files.select(F.sha2(canonical(F.col("value")), 256).alias("digest"), name.alias("license_id")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, notices: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, license_id, notices): the licence that the whole text is, and those that its lines declare.

    known and notices: (digest, license_id) tables, by default the built-in ones (of a fixed size, so broadcast; given
    tables are joined as Catalyst sees fit). Null text counts as empty: a digest, no licence. notices are distinct,
    sorted and comma-joined, null if none. Repeated rows give equal rows; rows with a null doc_id are kept; an empty
    table gives no rows; texts of any length are digested whole; other columns are left out.
    """
    spark = docs.sparkSession
    known = F.broadcast(digests(spark, KNOWN, DIGESTS)) if known is None else known
    notices = F.broadcast(digests(spark, NOTICES)) if notices is None else notices
    held = docs.select("doc_id", text_or_empty().alias("_sw_text"))
    whole = held.select("doc_id", F.md5("_sw_text").alias("_sw_key"), F.sha2(canonical(F.col("_sw_text")), 256).alias("digest"))
    some = held.filter(F.col("_sw_text").rlike(_DECLARES)).select(F.md5("_sw_text").alias("_sw_key"), "_sw_text")
    lines = some.select("_sw_key", F.explode(F.split("_sw_text", "\n")).alias("line"))
    lines = lines.filter(F.col("line").rlike(_DECLARES)).select("_sw_key", F.sha2(F.regexp_replace(canonical(F.col("line")), POINTER, ""), 256).alias("digest"))
    said = lines.join(notices, "digest").groupBy("_sw_key").agg(F.array_join(F.sort_array(F.collect_set("license_id")), ",").alias("notices"))
    return whole.join(known, "digest", "left").join(said, "_sw_key", "left").select("doc_id", "digest", "license_id", "notices")


def oracle() -> str:
    """The same in DuckDB."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"

    def canon(x: str) -> str:
        plain = f"trim(regexp_replace(regexp_replace(lower({x}), {lit(COPYRIGHT)}, '\\1', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        cases = " ".join(f"when {lit(v)} then {lit(u)}" for v, u in EQUIVALENTS)
        spelt = f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: case w {cases} else w end), ' ')"
        for pair, one in PAIRS:
            spelt = f"regexp_replace({spelt}, '(^| ){pair}( |$)', '\\1{one}\\2', 'g')"
        return spelt

    values = lambda rows: ", ".join(f"({lit(i)}, {lit(t)})" for i, t in rows)
    known = lambda rows: f"select sha256({canon('t')}) as digest, i from (values {values(rows)}) v(i, t)"
    ready = f" union all select d, i from (values {values(DIGESTS)}) v(i, d)" if DIGESTS else ""
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
known as (select digest, min(i) as license_id from ({known(KNOWN)}{ready}) group by 1),
notice as (select digest, min(i) as license_id from ({known(NOTICES)}) group by 1),
w as (select doc_id, t, sha256({canon('t')}) as digest from d),
lines as (select distinct t, unnest(string_split(t, chr(10))) as line from d where regexp_matches(t, {lit(_DECLARES)})),
said as (select t, string_agg(license_id, ',' order by license_id) as notices from
  (select distinct l.t, n.license_id from lines l join notice n on n.digest = sha256(regexp_replace({canon('l.line')}, {lit(POINTER)}, '', 'g')) where regexp_matches(l.line, {lit(_DECLARES)})) group by t)
select w.doc_id, w.digest, k.license_id, s.notices from w left join known k using (digest) left join said s on s.t = w.t"""
