import textwrap

import pytest

from kalendarium.llm import licence_rules
from tests.llm.tables import documents, odd_rows, prose, rows

S = licence_rules.SENTENCES


def found(spark, *texts):
    df = licence_rules.find_licences(documents(spark, list(enumerate(texts))))
    return rows(df, "doc_id", "licence", "rule", "first_sentence", "n_matches")


def test_notices_and_sequences(spark):
    mit = "\n".join(S[n] + "." for n in ("mit-grant", "mit-keep", "mit-as-is"))
    got = found(
        spark,
        "Some prose here.\n" + S["mit-notice"] + ".\nMore prose.",
        mit,
        f"x.\n{S['mit-grant']}\nother.\n{S['mit-keep']}.\n{S['mit-as-is']}.",
        "\n".join([S["mit-grant"], *["filler"] * 9, S["mit-keep"] + ".", S["mit-as-is"] + "."]),
        f"{S['apache-header']}. {S['apache-copy']} https://x. {S['apache-as-is']}.",
        "  licensed UNDER CC-BY   NC 4.0! Then text. " + S["cc-by-nc-notice"] + ".",
        "Licensed under the MIT Licence.",
        None,
        "",
    )
    assert got == [
        (0, "MIT", "mit-notice", 1, 1), (1, "MIT", "mit-text", 0, 1), (2, "MIT", "mit-text", 1, 1), (3, "MIT", "mit-grant", 0, 1),
        (4, "Apache-2.0", "apache-header", 0, 1), (5, "CC-BY-NC-4.0", "cc-by-nc-notice", 0, 2),
    ]


def test_sentence_at_the_very_end_and_repeats(spark):
    text = prose(3, 50) + "\n" + S["gpl3-notice"] + "."
    assert [(r[1], r[4]) for r in found(spark, text)] == [("GPL-3.0-only", 1)]
    assert found(spark, *[S["mit-notice"] + "\nx\n" + S["mit-notice"]] * 1) == [(0, "MIT", "mit-notice", 0, 2)]


def test_odd_rows(spark):
    given = odd_rows() + [(40, S["all-rights"] + ". " + S["bsd-redistribution"])] * 2 + [(None, S["mit-notice"])]
    df = licence_rules.find_licences(documents(spark, given))
    assert rows(df, "doc_id", "rule") == sorted([(40, "bsd-2"), (40, "bsd-2"), (None, "mit-notice")], key=repr)
    assert licence_rules.find_licences(documents(spark, [])).collect() == []
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


MIT = """MIT License

Copyright (c) 2020 Some Body

{mit-grant}

{mit-keep}.

{mit-as-is}. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
APACHE = """Copyright 2020 Some Body

{apache-header}.
{apache-copy}

    http://www.apache.org/licenses/LICENSE-2.0

{apache-as-is}.
See the License for the specific language governing permissions and limitations under the License."""
GPL = """{gpl-free}.

{gpl-hope}.  See the GNU General Public License for more details.

{gpl-received}.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Copyright (c) 2020, Some Body

{bsd-redistribution}

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. {bsd-endorse}.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
STANDARD = [(MIT, "MIT", "mit-text"), (APACHE, "Apache-2.0", "apache-full-header"), (GPL, "GPL-3.0-or-later", "gpl3-or-later-full"), (BSD, "BSD-3-Clause", "bsd-3")]


@pytest.mark.parametrize("width", [70, 79, 10_000])
def test_standard_texts_wrapped(spark, width):
    for comment in ("", " * ", "# "):
        texts = []
        for form, *_ in STANDARD:
            lines = [line for part in form.format(**S).split("\n") for line in textwrap.wrap(part, width) or [""]]
            texts.append("\n".join((comment + line).rstrip() for line in lines))
        texts.append(texts[3].replace("3. Neither", "3) Neither").replace("\n", "\r\n"))
        got = found(spark, *texts)
        assert [(i, licence, rule, n) for i, licence, rule, _, n in got] == [(i, licence, rule, 1) for i, (_, licence, rule) in enumerate(STANDARD + STANDARD[3:])]
        # the piece in which the sequence begins
        assert got[0][3] == 4 and texts[0].split("\n")[4].strip(" *#").startswith("Permission")


def test_wrapping_ends_at_stops_and_blank_lines(spark):
    half = S["gpl3-notice"].index(" under")
    texts = [S["gpl3-notice"][:half] + end + S["gpl3-notice"][half + 1:] for end in ("\n", "\r\n * ", "\n\n", ". ", "\n *\n")]
    assert [r[0] for r in found(spark, *texts)] == [0, 1]
    # wrapped sentences between two known ones count one each
    other = "\n".join(textwrap.wrap("This is some other sentence that goes on over several lines of the file. " * 4, 60))
    near, far = (S["bsd-redistribution"] + "\n" + "\n".join([other] * n) + "\n" + S["bsd-endorse"] for n in (0, 1))
    assert [r[2] for r in found(spark, near.replace("\n\n", "\n"), far)] == ["bsd-3", "bsd-2"]


def test_spdx_lines_and_other_common_licences(spark):
    for rule, (licence, sentence) in licence_rules.COMMON.items():
        assert licence in licence_rules.SPDX, rule
    common = list(licence_rules.COMMON.items())
    texts = ["x\n" + "\n".join(" * " + line for line in textwrap.wrap(sentence + ".", 72)) + "\nMore text." for _, (_, sentence) in common]
    texts += ["/* SPDX-License-Identifier: GPL-2.0+ */", "// SPDX-License-Identifier: MIT-0"]
    expected = [(i, licence, rule, 1, 1) for i, (rule, (licence, _)) in enumerate(common)] + [(len(common), "GPL-2.0", "spdx-gpl-2.0", 0, 1)]
    assert found(spark, *texts) == sorted(expected, key=repr)
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    assert [r[1] for r in found(spark, mpl)] == ["MPL-2.0"]
