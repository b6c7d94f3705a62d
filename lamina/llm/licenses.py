"""Licence scan by canonical digest.

Texts are brought to one form, native expressions only: lower case, copyright lines
removed, equivalent spellings made one, punctuation and white space reduced to single
spaces. The digest of the whole form is looked up among those of known licences, which
are brought to the same form by the same expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of equivalent spellings, in natural order.
SPELLINGS = {
    "licence": "license",
    "organisation": "organization",
    "authorise": "authorize",
    "merchantibility": "merchantability",
    "non-infringement": "noninfringement",
    "noncommercial": "non-commercial",
    "per cent": "percent",
    "https://": "http://",
    "©": "(c)",
}

#: A whole line that states a copyright, whatever stands before it as a comment sign: with a year or a sign for it, since
#: lines of the licence itself may begin with the word.
COPYRIGHT_LINE = (
    r"(?m)^[ \t#*/;%-]*(?:copyright\b[^\n]*(?:[12][0-9][0-9][0-9]|\(c\))[^\n]*|\(c\) ?[12][0-9][0-9][0-9][^\n]*|all rights reserved[. ]*)$"
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_0BSD = _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_BSL = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""

_MIT_0 = _MIT.split("\n\n")[0].replace(", subject to the following conditions:", ".") + "\n\n" + _MIT.split("\n\n")[2]

_APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu_header(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free "
        f"Software Foundation, either version {version} of the License, or (at your option) any later version.\n\n"
        f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\n"
        f"You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


#: Texts of known licences and notices by their short identifiers.
KNOWN = {
    "MIT": _MIT,
    "MIT (with title)": "MIT License\n\n" + _MIT,
    "ISC": _ISC,
    "0BSD": _0BSD,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_TAIL,
    "Zlib": _ZLIB,
    "MIT-0": _MIT_0,
    "BSL-1.0": _BSL,
    "Unlicense": _UNLICENSE,
    "Apache-2.0 (header)": _APACHE_HEADER,
    "MPL-2.0 (header)": _MPL_HEADER,
    "GPL-2.0-or-later (header)": _gnu_header("GNU General Public License", "2"),
    "GPL-3.0-or-later (header)": _gnu_header("GNU General Public License", "3"),
    "LGPL-2.1-or-later (header)": _gnu_header("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0-or-later (header)": _gnu_header("GNU Lesser General Public License", "3"),
    "AGPL-3.0-or-later (header)": _gnu_header("GNU Affero General Public License", "3"),
    "CC-BY-4.0 (notice)": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 (notice)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 (notice)": "Licensed under CC BY-NC 4.0.",
    "MIT (notice)": "Licensed under the MIT License.",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0.",
}


#: Digests of the canonical form of long licence texts, as Debian has them in /usr/share/common-licenses.
DIGESTS = {
    "Apache-2.0": "1503ed7ce6c2188ed269646562607a76b5c74bff588f36b20862ee3af525f3ea",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "BSD-3-Clause (Regents)": "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "3842a16357f0cdd1e23bb92ec7360a85dcebc4d690aa011625db0b4c951608b1",
    "GFDL-1.3": "af67fd0f1a174a4bcb2f40070ab1d7b5e3519fd4e36fa89113923de9a4638f52",
    "GPL-1.0": "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    "GPL-2.0": "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
    "GPL-3.0": "3c39b58d51baf32b2a21a55c429305f51cfd82e53cad05134293933580b4cd84",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def canonical(text: Column) -> Column:
    """The form that digests are taken of."""
    form = F.lower(text)
    for one, other in SPELLINGS.items():
        form = F.replace(form, F.lit(one), F.lit(other))
    form = F.regexp_replace(form, COPYRIGHT_LINE, " ")
    return F.trim(F.regexp_replace(form, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(license, digest) of the texts given, or else of ``KNOWN`` and ``DIGESTS``; of licences with one form the first by name."""
    rows = spark.createDataFrame(sorted((known or KNOWN).items()), "license string, text string")
    rows = rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    if known is None:
        rows = rows.unionByName(spark.createDataFrame(sorted(DIGESTS.items()), "license string, digest string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(
    docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, canonical_sha256, license (null if none is known).

    A null text counts as empty; a text without letters and digits has the empty form,
    which is no licence. Null and repeated ids are looked up as any others; other columns
    are ignored. ``known`` may have any size: Spark chooses how to join it.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    empty = F.sha2(F.lit(""), 256)
    hashed = docs.select(
        F.col(id_col).alias("__id"), F.sha2(canonical(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("digest")
    )
    return hashed.join(known.where(F.col("digest") != empty), "digest", "left").select(
        F.col("__id").alias(id_col), F.col("digest").alias("canonical_sha256"), "license"
    )
