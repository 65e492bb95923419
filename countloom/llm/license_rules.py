"""Licence scans by sentence rules.

A text is cut into sentences, which are normalised and mapped to the identifiers of known licence
sentences: by the dictionary of whole sentences, else by phrases, for sentences that only refer to a licence or
name a holder.  Sequences of identifiers are matched against ordered licence rules.  A rule
takes the identifiers it matches, so a later, more general rule does not see them again; what
no rule explains is reported as unknown.  Everything happens within a row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from countloom.llm.common import bounded_batches, utf8_list

# Sentences of licences and of their usual notices, cut where the scan cuts.
WHOLE = """
mit_grant: Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions
mit_notice: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
as_is: THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT
mit_liability: IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE
isc_grant: Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
isc_grant: Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
zero_bsd_grant: Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted
isc_disclaimer: THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
isc_liability: IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE
bsd_redistribution: Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
bsd_source: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
bsd_binary: Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution
bsd_endorsement: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd_disclaimer: THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED
bsd_liability: IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES
bsd_loss: LOSS OF USE, DATA, OR PROFITS
bsd_cause: OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE
zlib_warranty: This software is provided 'as-is', without any express or implied warranty
zlib_liability: In no event will the authors be held liable for any damages arising from the use of this software
zlib_grant: Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions
zlib_origin: The origin of this software must not be misrepresented
zlib_claim: you must not claim that you wrote the original software
zlib_altered: Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
zlib_notice: This notice may not be removed or altered from any source distribution
unlicense_release: This is free and unencumbered software released into the public domain
unlicense_grant: Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means
unlicense_dedication: In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain
unlicense_benefit: We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
unlicense_act: We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law
boost_grant: Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following
apache2_reference: Licensed under the Apache License, Version 2.0 (the "License")
apache_compliance: you may not use this file except in compliance with the License
apache_basis: Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied
apache_specific: See the License for the specific language governing permissions and limitations under the License
gpl_free: This program is free software
gpl2_or_later: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version
gpl_terms: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation
gpl3_or_later: it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
gpl3_or_later: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
lgpl_terms: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation
lgpl21_version: either version 2.1 of the License, or (at your option) any later version
gpl2_version: either version 2 of the License, or (at your option) any later version
gpl2_only: version 2 of the License
gpl2_only: either version 2 of the License
gpl2_only: version 2 of the License only
gpl2_reference: you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation
gpl2_reference: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2 of the License
gpl2_reference: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2
gpl3_only: version 3 of the License
gpl3_only: version 3 of the License only
gpl3_reference: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation
gpl3_reference: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License
gpl3_reference: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3
lgpl21_only: version 2.1 of the License
lgpl21_only: version 2.1 of the License only
lgpl3_or_later: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
agpl3_or_later: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version
lgpl_free: This library is free software
gpl_hope: This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY
lgpl_hope: This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY
gpl_warranty: without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE
gpl_details: See the GNU General Public License for more details
lgpl_details: See the GNU Lesser General Public License for more details
agpl_details: See the GNU Affero General Public License for more details
gpl_copy: You should have received a copy of the GNU General Public License along with this program
lgpl_copy: You should have received a copy of the GNU Lesser General Public License along with this library
agpl_copy: You should have received a copy of the GNU Affero General Public License along with this program
mit_heading: MIT License
mit_heading: The MIT License
mit_heading: The MIT License (MIT)
apache2_heading: Apache License Version 2.0, January 2004
apache2_heading: Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
apache2_heading: Apache License Version 2.0, January 2004 https://www.apache.org/licenses/
apache_terms: TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
apache_definition: "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document
end_of_terms: END OF TERMS AND CONDITIONS
apache_appendix: How to apply the Apache License to your work
gpl3_heading: GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
gpl2_heading: GNU GENERAL PUBLIC LICENSE Version 2, June 1991
lgpl3_heading: GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007
lgpl21_heading: GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999
agpl3_heading: GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007
gnu_preamble: The GNU General Public License is a free, copyleft license for software and other kinds of works
gnu_preamble: The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software
gnu_preamble: The licenses for most software are designed to take away your freedom to share and change it
gnu_preamble: The licenses for most software and other practical works are designed to take away your freedom to share and change the works
lgpl3_incorporates: This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below
gpl_apply: How to Apply These Terms to Your New Programs
gpl_apply: How to Apply These Terms to Your New Libraries
mpl2_heading: Mozilla Public License Version 2.0
mpl2_header: This Source Code Form is subject to the terms of the Mozilla Public License, v
mpl2_copy: If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/
mpl2_copy: If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/
epl2_header: This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/
perl_terms: you can redistribute it and/or modify it under the same terms as Perl itself
cc0_waiver: To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work
cc_by_reference: This work is licensed under a Creative Commons Attribution 4.0 International License
cc_by_sa_reference: This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License
cc_by_nc_reference: This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License
cc_by_nd_reference: This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License
"""

# Names in tags "SPDX-License-Identifier:".
SPDX = """
MIT ISC 0BSD BSD-2-Clause BSD-3-Clause Zlib Unlicense BSL-1.0 Apache-2.0 MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0
GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later
""".split() + ["MIT OR Apache-2.0", "Apache-2.0 OR MIT"]

# Phrases of sentences that vary, after normalisation, most specific first.
SENTENCES = [
    ("spdx_other", r"^spdx license identifier "),
    ("fsf_verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("apache2_reference", r"licensed under the apache license version 2\.0"),
    ("apache_reference", r"licensed under the apache license"),
    ("apache_compliance", r"you may not use this file except in compliance with the license"),
    ("apache_copy", r"you may obtain a copy of the license at"),
    ("apache_basis", r"distributed on an as is basis"),
    ("boost_reference", r"(distributed|licensed) under the boost software license version 1\.0"),
    ("epl2_reference", r"eclipse public license (version |v ?)?2\.0"),
    ("agpl3_reference", r"gnu affero general public license version 3"),
    ("lgpl3_reference", r"gnu lesser general public license version 3"),
    ("lgpl2_reference", r"gnu lesser general public license version 2"),
    ("gpl_later", r"gnu general public license .*version [123].* any later version"),
    ("gpl3_reference", r"gnu general public license version 3"),
    ("gpl2_reference", r"gnu general public license version 2"),
    ("gpl_warranty", r"without even the implied warranty of merchantability"),
    ("mit_reference", r"(released|licensed|distributed) under the (terms of the )?mit license"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included"),
    ("as_is", r"the software is provided as is without warranty of any kind"),
    ("bsd_redistribution", r"redistribution and use in source and binary forms"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorsement", r"neither the name of .* may be used to endorse or promote"),
    ("bsd_disclaimer", r"this software is provided by the .* as is"),
    ("mpl2_reference", r"mozilla public license v(ersion)? ?\.? ?2\.0"),
    ("cc0_reference", r"cc0 1\.0"),
    ("cc_by_nc_reference", r"licensed under cc by nc 4\.0"),
    ("cc_by_sa_reference", r"licensed under cc by sa 4\.0"),
    ("cc_by_nd_reference", r"licensed under cc by nd 4\.0"),
    ("cc_by_reference", r"licensed under cc by 4\.0"),
    ("public_domain", r"(released into|placed in|dedicated to) the public domain"),
    ("unlicensed_statement", r"(licensed|released|distributed) under .*licen[cs]e"),
]

# Ordered rules over sequences of identifiers, each in angle brackets.
RULES = [
    ("BSD-3-Clause", r"<bsd_redistribution>?<bsd_source><bsd_binary><bsd_endorsement><bsd_disclaimer>?<bsd_liability>?<bsd_loss>?<bsd_cause>?"),
    ("BSD-2-Clause", r"<bsd_redistribution>?<bsd_source><bsd_binary><bsd_disclaimer>?<bsd_liability>?<bsd_loss>?<bsd_cause>?"),
    ("MIT", r"(?:<mit_heading>|<mit_reference>)?<mit_grant><mit_notice><as_is>?<mit_liability>?"),
    ("ISC", r"<isc_grant><isc_disclaimer>?<isc_liability>?"),
    ("0BSD", r"<zero_bsd_grant><isc_disclaimer>?<isc_liability>?"),
    ("Zlib", r"<zlib_warranty><zlib_liability>?<zlib_grant><zlib_origin>?<zlib_claim>?<zlib_altered>?<zlib_notice>?"),
    ("Unlicense", r"<unlicense_release><unlicense_grant><unlicense_dedication>?<unlicense_benefit>?<unlicense_act>?<as_is>?<mit_liability>?"),
    ("BSL-1.0", r"<boost_reference>?<boost_grant><as_is>?"),
    ("BSL-1.0", r"<boost_reference>"),
    ("Apache-2.0", r"<apache2_heading>(?:<apache_terms>|<apache_definition>|<unlicensed_statement>|<apache_basis>|<end_of_terms>)*(?:<apache_appendix>(?:<apache2_reference><apache_compliance>?<apache_copy>?<apache_basis>?<apache_specific>?)?)?"),
    ("Apache-2.0", r"<apache2_reference><apache_compliance>?<apache_copy>?<apache_basis>?<apache_specific>?"),
    ("MPL-2.0", r"<mpl2_heading><unlicensed_statement>*(?:<mpl2_header><mpl2_copy>?)?"),
    ("AGPL-3.0", r"<agpl3_heading>(?:<fsf_verbatim>|<gnu_preamble>|<unlicensed_statement>|<gpl_warranty>|<end_of_terms>)*(?:<gpl_apply>(?:<gpl_free><agpl3_or_later><gpl_hope>?<gpl_warranty>?<agpl_details>?<agpl_copy>?)?)?"),
    ("LGPL-3.0", r"<lgpl3_heading>(?:<fsf_verbatim>|<gnu_preamble>|<unlicensed_statement>|<gpl_warranty>|<end_of_terms>)*<lgpl3_incorporates>?"),
    ("LGPL-2.1", r"<lgpl21_heading>(?:<fsf_verbatim>|<gnu_preamble>|<unlicensed_statement>|<gpl_warranty>|<end_of_terms>)*(?:<gpl_apply>(?:<lgpl_free><lgpl_terms><lgpl21_version><lgpl_hope>?<gpl_warranty>?<lgpl_details>?<lgpl_copy>?)?)?"),
    ("GPL-3.0", r"<gpl3_heading>(?:<fsf_verbatim>|<gnu_preamble>|<unlicensed_statement>|<gpl_warranty>|<end_of_terms>)*(?:<gpl_apply>(?:<gpl_free><gpl3_or_later><gpl_hope>?<gpl_warranty>?<gpl_details>?<gpl_copy>?)?)?"),
    ("GPL-2.0", r"<gpl2_heading>(?:<fsf_verbatim>|<gnu_preamble>|<unlicensed_statement>|<gpl_warranty>|<end_of_terms>)*(?:<gpl_apply>(?:<gpl_free><gpl_terms><gpl2_version><gpl_hope>?<gpl_warranty>?<gpl_details>?<gpl_copy>?)?)?"),
    ("AGPL-3.0", r"<gpl_free>?<agpl3_reference><gpl_hope>?<gpl_warranty>?<agpl_details>?<agpl_copy>?"),
    ("AGPL-3.0-or-later", r"<gpl_free>?<agpl3_or_later><gpl_hope>?<gpl_warranty>?<agpl_details>?<agpl_copy>?"),
    ("LGPL-3.0", r"<lgpl_free>?<lgpl3_reference><lgpl_hope>?<gpl_warranty>?<lgpl_details>?<lgpl_copy>?"),
    ("LGPL-3.0-or-later", r"<lgpl_free>?<lgpl3_or_later><lgpl_hope>?<gpl_warranty>?<lgpl_details>?<lgpl_copy>?"),
    ("LGPL-2.1-or-later", r"<lgpl_free>?<lgpl_terms><lgpl21_version><lgpl_hope>?<gpl_warranty>?<lgpl_details>?<lgpl_copy>?"),
    ("LGPL-2.1", r"<lgpl_free>?(?:<lgpl_terms><lgpl21_only>|<lgpl2_reference>)<lgpl_hope>?<gpl_warranty>?<lgpl_details>?<lgpl_copy>?"),
    ("GPL-3.0-or-later", r"<gpl_free>?<gpl3_or_later><gpl_hope>?<gpl_warranty>?<gpl_details>?<gpl_copy>?"),
    ("GPL-3.0", r"<gpl_free>?(?:<gpl_terms><gpl3_only>|<gpl3_reference>)<gpl_hope>?<gpl_warranty>?<gpl_details>?<gpl_copy>?"),
    ("GPL-2.0-or-later", r"<gpl_free>?(?:<gpl_terms><gpl2_version>|<gpl2_or_later>)<gpl_hope>?<gpl_warranty>?<gpl_details>?<gpl_copy>?"),
    ("GPL-2.0", r"<gpl_free>?(?:<gpl_terms><gpl2_only>|<gpl2_reference>)<gpl_hope>?<gpl_warranty>?<gpl_details>?<gpl_copy>?"),
    ("GPL-or-later", r"<gpl_free>?<gpl_later><gpl_hope>?<gpl_warranty>?<gpl_details>?<gpl_copy>?"),
    ("GPL", r"<gpl_free>?<gpl_terms><gpl_hope>?<gpl_warranty>?<gpl_details>?<gpl_copy>?"),
    ("LGPL", r"<lgpl_free>?<lgpl_terms><lgpl_hope>?<gpl_warranty>?<lgpl_details>?<lgpl_copy>?"),
    ("MPL-2.0", r"<mpl2_header><mpl2_copy>?"),
    ("MPL-2.0", r"<mpl2_reference><mpl2_copy>?"),
    ("MIT", r"<mit_reference><as_is>?"),
    ("MIT", r"<mit_heading>"),
    ("EPL-2.0", r"<epl2_header>"),
    ("EPL-2.0", r"<epl2_reference>"),
    ("Artistic-1.0-Perl OR GPL", r"<perl_terms>"),
    ("CC0-1.0", r"<cc0_waiver>"),
    ("CC0-1.0", r"<cc0_reference>"),
    ("CC-BY-NC-4.0", r"<cc_by_nc_reference>"),
    ("CC-BY-SA-4.0", r"<cc_by_sa_reference>"),
    ("CC-BY-ND-4.0", r"<cc_by_nd_reference>"),
    ("CC-BY-4.0", r"<cc_by_reference>"),
    ("Unlicense", r"<unlicense_release>"),
    ("public-domain", r"<public_domain>"),
]

RULES += [(name.removesuffix("-only"), f"<spdx_{re.sub('[-. ]', '_', name.lower())}>") for name in SPDX]
RULES.append(("unknown", "(?:,[a-z0-9_]+,)+"))

# Every known sentence holds one of these, so other texts need no cutting.  A blank stands for
# all that normalisation turns into one: line breaks, hyphens and other marks.
TRIGGERS = (
    "licen", "redistribut", "permission", "copyright notice", "warrant", "this software", "cc0", "endorse", "public domain", "as is", "in no event",
    "loss of use", "original software", "this notice", "dedication", "free software", "perl itself", "of the mpl", "terms and conditions", "these terms",
)

TRIGGER = re.compile("|".join(TRIGGERS).replace(" ", "[^a-z0-9.]+").encode(), re.IGNORECASE)
END = re.compile(r"[.!?;:](?=[ \t\n\r]|$)|\n[ \t\r]*\n")
OTHER = re.compile(r"[^a-z0-9.]+")
PHRASES = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
#: An identifier has a comma before and after it, so that neighbours share none and every one of a row can match.
SEQUENCES = [(name, re.sub("<([a-z0-9_]+)>", r"(?:,\1,)", pattern)) for name, pattern in RULES]
ORDERED = [(name, re.compile(pattern)) for name, pattern in SEQUENCES]
#: A tag is a sentence of its own, up to the end of its expression; a plus says "or later".
TAG, PLUS = r"spdx-license-identifier:[ \t]*([a-z0-9.() -]*)", r"(spdx-license-identifier:[ \t]*[a-z0-9.-]+)\+"
TAGS = re.compile(TAG, re.IGNORECASE), re.compile(PLUS, re.IGNORECASE)


def sentences(text: str) -> list[str]:
    """Normalised sentences: lower case, single blanks, no marks but inner full stops."""
    out = []
    for part in END.split(TAGS[0].sub(r". spdx license identifier \1. ", TAGS[1].sub(r"\1-or-later", text))):
        plain = OTHER.sub(" ", part.translate(LOWER)).strip(" .")
        if plain:
            out.append(plain)
    return out


LOWER = {c: c + 32 for c in range(65, 91)}
#: Identifiers by normalised sentence.
KNOWN = {plain: name for name, sentence in (line.split(": ", 1) for line in WHOLE.strip().split("\n")) for plain in sentences(sentence)}
KNOWN |= {f"spdx license identifier {' '.join(re.findall('[a-z0-9.]+', name.lower()))}": f"spdx_{re.sub('[-. ]', '_', name.lower())}" for name in SPDX}


def identify(text: str) -> list[str]:
    """Identifiers of the known sentences, in order; of a sentence not in the dictionary the first fitting phrase tells."""
    found = []
    for s in sentences(text):
        name = KNOWN.get(s) or next((name for name, pattern in PHRASES if pattern.search(s)), None)
        if name:
            found.append(name)
    return found


def licences(identifiers: list[str]) -> list[str]:
    """Names of the rules that match, in rule order, each once."""
    rest = "".join(f",{i}," for i in identifiers)
    out: list[str] = []
    for name, pattern in ORDERED:
        taken, n = pattern.subn(",#,", rest)
        if n:
            rest = taken
            if name not in out:
                out.append(name)
    return out


def _run(batches):
    for batch in batches:
        ids, rules = [], []
        for t in utf8_list(batch.column(1)):
            found = identify(t.decode("utf-8", "replace")) if t and TRIGGER.search(t) else []
            ids.append(found)
            rules.append(licences(found))
        columns = [batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array([",".join(i) for i in ids]), pa.array([",".join(r) for r in rules])]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_sentences", "sentence_ids", "licences"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) of every row.

    sentence_ids: comma-joined identifiers in text order; licences: comma-joined names in rule
    order, each once however often it is named, "unknown" for sentences no rule takes (a tag with another expression among them); both empty without any, also for null and empty texts; very long texts
    are scanned whole.  Repeated rows are judged alike; other columns, whatever their names, are not read; an empty table
    has no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_run, "doc_id bigint, n_sentences bigint, sentence_ids string, licences string")


def oracle_sql() -> str:
    """The same as DuckDB SQL, from the same tables of sentences and rules."""
    case = " ".join(f"when regexp_matches(s, '{pattern}') then '{name}'" for name, pattern in SENTENCES)
    steps, columns = [], []
    for k, (_, pattern) in enumerate(SEQUENCES):
        last = f"r{k - 1}" if k else "r"
        steps.append(f"t{k} as (select *, regexp_matches({last}, '{pattern}') as m{k}, regexp_replace({last}, '{pattern}', ',#,', 'g') as r{k} from {f't{k - 1}' if k else 'seqs'})")
    for k, (name, _) in enumerate(RULES):  # a name stands where its first rule that matches does
        before = [f"m{j}" for j in range(k) if RULES[j][0] == name]
        columns.append(f"case when m{k}{f' and not ({' or '.join(before)})' if before else ''} then '{name}' end")
    whole = ", ".join(f"('{plain}', '{name}')" for plain, name in KNOWN.items())
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = f"translate(part, '{letters}', '{letters.lower()}')"
    tagged = f"regexp_replace(regexp_replace(coalesce(text, ''), '{PLUS}', '\\1-or-later', 'gi'), '{TAG}', '. spdx license identifier \\1. ', 'gi')"
    parts = f"string_split_regex(regexp_replace({tagged}, '[.!?;:]([ \\t\\n\\r]|$)', chr(1) || '\\1', 'g'), '\\x01|\\n[ \\t\\r]*\\n')"
    return f"""with parts as (select doc_id, unnest({parts}) as part, generate_subscripts({parts}, 1) as i from documents),
plain as (select doc_id, i, trim(regexp_replace({lowered}, '[^a-z0-9.]+', ' ', 'g'), ' .') as s from parts),
known(k, own) as (values {whole}),
named as (select doc_id, i, coalesce(own, case {case} end) as name from plain left join known on s = k),
ids as (select doc_id, count(name) as n_sentences, coalesce(string_agg(name, ',' order by i), '') as sentence_ids from named group by doc_id),
seqs as (select *, case when n_sentences > 0 then ',' || replace(sentence_ids, ',', ',,') || ',' else '' end as r from ids),
{", ".join(steps)}
select doc_id, n_sentences, sentence_ids, concat_ws(',', {", ".join(columns)}) as licences from t{len(RULES) - 1}"""
