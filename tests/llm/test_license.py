import re

from tidemill.llm import license_scan as ls

SEEN = {"MIT": "under the MIT License", "GPL": "GNU General Public License, version", "Apache": "Apache License, Version", "CC-BY-NC": "CC BY-NC"}


def test_calibration_split_accuracy():
    assert ls.load(ls.Params()).held_out_accuracy > 0.93


def test_every_licence_line_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id: ",".join(sorted(k for k, p in SEEN.items() if re.search(p, r.text))) for r in docs.collect()}
    got = {r.doc_id: r.families for r in ls.scan(docs).collect()}
    assert got == want and sum(map(bool, want.values())) > 3


def test_edges(spark):
    wrapped = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without restriction"
    rows = [(1, None), (2, ""), (2, "MIT"), (3, "Ünïcode héad. " + wrapped + "\nmore prose"), (None, "Licensed under the ISC License."), (4, "His license was suspended under the new law."), (5, "words " * 50_000 + "Licensed under CC BY 4.0."), (6, "permitted the use of source and notice copyright above the")]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, families string")
    got = {(r.doc_id, r.families): r for r in ls.scan(docs).collect()}
    assert set(got) == {(1, ""), (2, ""), (3, "MIT"), (None, "ISC"), (4, ""), (5, "CC-BY"), (6, "")}
    f = got[(3, "MIT")].found[0]
    assert rows[3][1].encode()[f.start : f.end].decode().startswith("Permission is hereby granted")
    assert ls.scan(docs.where("false")).count() == 0
    assert {(r.doc_id, r.family) for r in ls.confirmed(docs).collect()} == {(3, "MIT"), (None, "ISC"), (5, "CC-BY")}


#: Whole notices as files have them: paragraphs that are templates of their own run into one.
WHOLE = {
    "BSD": """Copyright (c) 2020, Some Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
""",
    "GPL": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
""",
    "MIT": """MIT License

Copyright (c) 2020 Some Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "Apache": """Copyright 2020 Some Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
""",
    "ISC": """Copyright (c) 2020, Some Author

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    "LGPL": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA  02110-1301  USA
""",
}
WHOLE["AGPL"] = WHOLE["GPL"].replace("GNU General", "GNU Affero General")


def test_whole_notices(spark):
    texts = {k: (f"intro words of a readme\n\n{t}\nand then the code", k) for k, t in WHOLE.items()}
    texts["# GPL"] = ("".join(f"# {x}\n" for x in WHOLE["GPL"].splitlines()), "GPL")
    bsd = WHOLE["BSD"]
    texts["core"] = (bsd[bsd.index("Redis") : bsd.index("THIS")], "BSD")
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts.values())], "doc_id long, text string")
    got = {r.doc_id: (r.families, r.n_confirmed) for r in ls.scan(docs).collect()}
    assert got == {i: (k, 1) for i, (_, k) in enumerate(texts.values())}
