"""License scan: an Aho-Corasick automaton over tags and notice phrases, and a shunting-yard
evaluation of and / or / with expressions.

White space is folded and case ignored before the scan, so a notice may be wrapped. A hit must
stand free of letters and digits; of hits that overlap the first counts, of several from one place
the longest. What follows an SPDX-License-Identifier tag is read as the longest valid expression
of its line. There the first operand may be any word, since a tag names a licence, known or not;
further ones must look like identifiers, so that prose after a tag is not taken for a licence.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyvec.llm.textvec import resident, slices

PERMISSIVE, WEAK, COPYLEFT, NONCOMMERCIAL, CLOSED = range(5)
CLASSES = ("permissive", "weak copyleft", "copyleft", "non-commercial", "closed or unknown")

#: By identifier: its class and the phrases that announce it.
LICENSES: dict[str, tuple[int, tuple[str, ...]]] = {
    "MIT": (PERMISSIVE, ("mit license", "mit licence", "permission is hereby granted, free of charge, to any person obtaining a copy")),
    "Apache-2.0": (PERMISSIVE, ("apache license, version 2.0", "apache license 2.0", "apache license version 2.0", "apache-2.0 license")),
    "BSD-2-Clause": (PERMISSIVE, ("bsd 2-clause", "simplified bsd license", "2-clause bsd")),
    "BSD-3-Clause": (PERMISSIVE, ("bsd 3-clause", "new bsd license", "modified bsd license", "3-clause bsd")),
    "ISC": (PERMISSIVE, ("isc license",)),
    "Zlib": (PERMISSIVE, ("zlib license",)),
    "Unlicense": (PERMISSIVE, ("the unlicense", "released into the public domain")),
    "CC0-1.0": (PERMISSIVE, ("cc0 1.0", "creative commons zero")),
    "CC-BY-4.0": (PERMISSIVE, ("cc by 4.0", "cc-by-4.0", "creative commons attribution 4.0")),
    "CC-BY-SA-4.0": (COPYLEFT, ("cc by-sa 4.0", "cc-by-sa-4.0", "creative commons attribution-sharealike 4.0")),
    "CC-BY-NC-4.0": (NONCOMMERCIAL, ("cc by-nc 4.0", "cc-by-nc-4.0", "creative commons attribution-noncommercial 4.0")),
    "CC-BY-NC-SA-4.0": (NONCOMMERCIAL, ("cc by-nc-sa 4.0", "cc-by-nc-sa-4.0")),
    "CC-BY-ND-4.0": (NONCOMMERCIAL, ("cc by-nd 4.0", "cc-by-nd-4.0")),
    "MPL-2.0": (WEAK, ("mozilla public license, version 2.0", "mozilla public license 2.0", "mozilla public license, v. 2.0")),
    "EPL-2.0": (WEAK, ("eclipse public license 2.0", "eclipse public license - v 2.0")),
    "LGPL-2.1": (WEAK, ("gnu lesser general public license, version 2.1", "lgpl-2.1", "lgplv2.1")),
    "LGPL-3.0": (WEAK, ("gnu lesser general public license, version 3", "lgpl-3.0", "lgplv3")),
    "GPL-2.0": (COPYLEFT, ("gnu general public license, version 2", "gnu general public license version 2", "gnu gpl v2", "gplv2")),
    "GPL-3.0": (COPYLEFT, ("gnu general public license, version 3", "gnu general public license version 3", "gnu gpl v3", "gplv3")),
    "AGPL-3.0": (COPYLEFT, ("gnu affero general public license, version 3", "gnu affero general public license version 3", "agplv3")),
    "LicenseRef-All-Rights-Reserved": (CLOSED, ("all rights reserved",)),
    "LicenseRef-Proprietary": (CLOSED, ("proprietary and confidential", "unauthorized copying of this file")),
}
#: Further identifiers that tags may name, by class. They announce themselves by no phrase.
MORE: dict[int, str] = {
    PERMISSIVE: """0BSD AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0 AML Apache-1.0 Apache-1.1 Artistic-1.0 Artistic-1.0-Perl Artistic-2.0 Beerware BlueOak-1.0.0 Borceux
        BSD-1-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-3-Clause-Modification BSD-3-Clause-Open-MPI BSD-4-Clause BSD-4-Clause-UC
        BSD-Protection BSD-Source-Code BSL-1.0 bzip2-1.0.5 bzip2-1.0.6 CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-PDDC CDLA-Permissive-1.0 CDLA-Permissive-2.0 CNRI-Python Crossword curl DOC ECL-1.0
        ECL-2.0 EFL-1.0 EFL-2.0 Entessa FSFAP FSFUL FSFULLR FTL Fair GD HPND ICU IJG ImageMagick Info-ZIP Intel JasPer-2.0 JSON Latex2e Leptonica Libpng libpng-2.0 libtiff Linux-OpenIB MirOS MIT-0 MIT-advertising MIT-CMU
        MIT-enna MIT-feh MIT-Modern-Variant MITNFA mpich2 MS-PL MTLL MulanPSL-1.0 MulanPSL-2.0 Multics NAIST-2003 NBPL-1.0 NCSA Net-SNMP NetCDF Newsletr NIST-PD NLPL NTP NTP-0 O-UDA-1.0 ODC-By-1.0 OFL-1.0 OFL-1.1
        OGTSL OLDAP-2.7 OLDAP-2.8 OML OpenSSL PDDL-1.0 PHP-3.0 PHP-3.01 Plexus PostgreSQL psfrag psutils PSF-2.0 Python-2.0 Python-2.0.1 Qhull Rdisc RSA-MD Ruby SAX-PD Saxpath SGI-B-2.0 SMLNJ SSH-OpenSSH SSH-short SunPro Swrule
        TCL TCP-wrappers TOSL TU-Berlin-1.0 TU-Berlin-2.0 UCL-1.0 Unicode-3.0 Unicode-DFS-2015 Unicode-DFS-2016 UPL-1.0 Vim VSL-1.0 W3C W3C-19980720 W3C-20150513 WTFPL X11 Xerox Xnet xpp XSkat Zed Zend-2.0 zlib-acknowledgement ZPL-1.1 ZPL-2.0 ZPL-2.1""",
    WEAK: """APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0 CDDL-1.0 CDDL-1.1 CECILL-C CPL-1.0 EPL-1.0 ErlPL-1.1 GPL-2.0-with-autoconf-exception GPL-2.0-with-bison-exception GPL-2.0-with-classpath-exception GPL-2.0-with-font-exception
        GPL-2.0-with-GCC-exception GPL-3.0-with-autoconf-exception GPL-3.0-with-GCC-exception IPL-1.0 LGPL-2.0 LGPLLR LPL-1.0 LPL-1.02 LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c MPL-1.0 MPL-1.1 MPL-2.0-no-copyleft-exception MS-RL Nokia NPL-1.0 NPL-1.1
        CDLA-Sharing-1.0 SPL-1.0 wxWindows""",
    COPYLEFT: """AGPL-1.0 CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CPAL-1.0 EUPL-1.0 EUPL-1.1 EUPL-1.2 GFDL-1.1 GFDL-1.2 GFDL-1.3 GPL-1.0 NGPL ODbL-1.0 OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1
        OSL-3.0 QPL-1.0 RPL-1.1 RPL-1.5 RPSL-1.0 Sleepycat SISSL SSPL-1.0 TAPR-OHL-1.0 CERN-OHL-S-2.0 CERN-OHL-W-2.0 Watcom-1.0""",
    NONCOMMERCIAL: """Aladdin CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-ND-1.0 CC-BY-NC-ND-2.0 CC-BY-NC-ND-2.5 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-1.0 CC-BY-NC-SA-2.0 CC-BY-NC-SA-2.5 CC-BY-NC-SA-3.0
        CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 NPOSL-3.0 PolyForm-Noncommercial-1.0.0 PolyForm-Small-Business-1.0.0 Parity-7.0.0 Prosperity-3.0.0""",
    CLOSED: "BUSL-1.1 Elastic-2.0 NONE NOASSERTION",
}
CLASS_OF: dict[str, int] = {k: v[0] for k, v in LICENSES.items()} | {k: kind for kind, names in MORE.items() for k in names.split()}
#: Exceptions that soften a copyleft licence to weak copyleft.
EXCEPTIONS = {
    x.lower(): x
    for x in """389-exception Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 CLISP-exception-2.0 DigiRule-FOSS-exception eCos-exception-2.0 FLTK-exception Font-exception-2.0
    freertos-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 gnu-javamail-exception GPL-3.0-linking-exception GPL-CC-1.0 i2p-gpl-java-exception LGPL-3.0-linking-exception Libtool-exception Linux-syscall-note LLVM-exception LZMA-exception
    mif-exception Nokia-Qt-exception-1.1 OCaml-LGPL-linking-exception OpenJDK-assembly-exception-1.0 openvpn-openssl-exception PS-or-PDF-font-exception-20170817 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 Qwt-exception-1.0 Swift-exception u-boot-exception-2.0
    Universal-FOSS-exception-1.0 WxWindows-exception-3.1""".split()
}
TAG = "spdx-license-identifier:"
_IDS = {k.lower(): k for k in CLASS_OF}
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.\-:]*\+?")
_RANK = {"or": 1, "and": 2, "with": 3}
_SUFFIX = re.compile(r"(\+|-only|-or-later)$")
#: An unknown operand that is an identifier all the same: a reference, or a name that ends in a version.
_NAMED = re.compile(r"(licenseref|documentref)-.+|[a-z][a-z0-9.]*(-[a-z0-9.]+)*-v?\d[\w.]*")
_EXCEPTION = re.compile(r"[a-z0-9.\-]*-(exception|note)(-[\w.]+)?|additionref-.+")


def identifier(word: str) -> tuple[str, int]:
    """(canonical name, class) of a licence word; -only, -or-later and + are understood."""
    low = word.lower()
    bare = low if low in _IDS else _SUFFIX.sub("", low)
    if bare in _IDS:
        return _IDS[bare] + ("-or-later" if bare != low and low.endswith(("+", "-or-later")) else ""), CLASS_OF[_IDS[bare]]
    return word, CLOSED


def named(word: str) -> bool:
    """Does the (lower-case) word look like a licence identifier?"""
    return identifier(word)[0] != word or word in _IDS or _NAMED.fullmatch(_SUFFIX.sub("", word)) is not None


def read_expression(text: str, at: int = 0) -> tuple[list[str], int]:
    """The tokens of the longest valid expression in the line of text from place at on, and where it ends.

    Tokens are taken while they can continue an expression: the first operand is any word, others
    must look like identifiers, and what follows with like an exception. Trailing operators and
    unclosed parentheses are given back."""
    out: list[str] = []
    good: tuple[int, int] = (0, at)
    depth, operand, first = 0, True, True
    while True:
        while at < len(text) and text[at] == " ":
            at += 1
        m = _TOKEN.match(text, at)
        if not m or m[0] == TAG:
            break
        word = m[0] if m[0] in "()" else m[0].rstrip(".:")
        if operand:
            if word == "(":
                if out and out[-1] == "with":
                    break
                depth += 1
            elif word in _RANK or word == ")":
                break
            elif out and out[-1] == "with":
                if not (word in EXCEPTIONS or _EXCEPTION.fullmatch(word)):
                    break
                operand = False
            else:
                if not (first or named(word)):
                    break
                operand = first = False
        elif word == ")" and depth:
            depth -= 1
        elif word in _RANK and not (word == "with" and (out[-1] == ")" or out[-2:-1] == ["with"])):
            operand = True
        else:
            break
        out.append(word)
        at = m.end() - (len(m[0]) - len(word))
        if not operand and depth == 0:
            good = (len(out), at)
        if word != m[0]:
            break
    return out[: good[0]], good[1]


def evaluate(tokens: list[str]) -> tuple[int, list[str], str]:
    """(class, licences, normal form) of an expression by the shunting-yard method.

    or takes the freer class, and the stricter; with a known exception softens copyleft. with
    binds closest, then and, then or; equals group from the left. The left side's names and parts
    grow in place, so that long chains cost what they are long."""
    values: list[tuple[int, set[str], list[str], int]] = []
    stack: list[str] = []

    def apply(op: str) -> None:
        right, left = values.pop(), values.pop()
        rank = _RANK[op]
        if op == "with":
            word = "".join(right[2])
            name = EXCEPTIONS.get(word.lower(), word)
            known = word.lower() in EXCEPTIONS
            kind = WEAK if known and left[0] == COPYLEFT else left[0] if known else CLOSED
            left[2].append(f" WITH {name}")
            values.append((kind, left[1], left[2], rank))
            return
        kind = min(left[0], right[0]) if op == "or" else max(left[0], right[0])
        for v in (left, right):
            if v[3] < rank:
                v[2][0] = "(" + v[2][0]
                v[2].append(")")
        left[1].update(right[1])
        left[2].append(f" {op.upper()} ")
        left[2].extend(right[2])
        values.append((kind, left[1], left[2], rank))

    for word in tokens:
        if word == "(":
            stack.append(word)
        elif word == ")":
            while stack[-1] != "(":
                apply(stack.pop())
            stack.pop()
        elif word in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                apply(stack.pop())
            stack.append(word)
        elif stack and stack[-1] == "with":
            values.append((CLOSED, set(), [word], 9))
        else:
            name, kind = identifier(word)
            values.append((kind, {name}, [name], 9))
    while stack:
        apply(stack.pop())
    kind, names, shown, _ = values[0]
    return kind, sorted(names), "".join(shown)


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word(TAG, (len(TAG), None))
    for name, (_, phrases) in LICENSES.items():
        for phrase in phrases:
            a.add_word(phrase, (len(phrase), name))
    a.make_automaton()
    return a


def scan_text(text: str, automaton) -> list[tuple[int, str, int, list[str]]]:
    """(place, expression, class, licences) of every tag and notice, by place in the folded text.

    Folding makes a run of white space one sign: a line break where it has one, else a blank."""
    lines = (" ".join(line.split()) for line in text.lower().splitlines())
    text = "\n".join(line for line in lines if line)
    spans = []
    for end, (size, name) in automaton.iter(text.replace("\n", " ")):
        start = end + 1 - size
        if (start and text[start - 1].isalnum()) or (name and end + 1 < len(text) and text[end + 1].isalnum()):
            continue
        spans.append((start, end + 1, name))
    found, reach = [], -1
    for start, end, name in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start < reach:
            continue
        if name is None:
            tokens, stop = read_expression(text, end)
            if tokens:
                kind, names, shown = evaluate(tokens)
                found.append((start, shown, kind, names))
                end = stop
        else:
            found.append((start, name, LICENSES[name][0], [name]))
        reach = end
    return found


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_hits, licenses, expression, category, allowed of every document with a hit.

    All notices of a document hold together: its expression joins the distinct ones by AND in
    order of appearance, its category is the strictest, and it is allowed if that is permissive or
    weak copyleft. Unknown identifiers count as closed. Null and empty texts have no hit; a null
    doc_id stays null; doc_id may be of any type. Repeated rows are scanned each; texts are scanned
    whole, however long; columns other than doc_id and text are ignored, whatever their names.
    Where phrases begin at one place the longest counts (no two are equal, so there are no other
    ties). An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        automaton = resident("licenses", _automaton)
        for whole in batches:
            for batch in slices(whole, "text"):
                keep, rows = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    hits = scan_text(text, automaton) if text else []
                    if hits:
                        shown = list(dict.fromkeys(h[1] for h in hits))
                        worst = max(h[2] for h in hits)
                        joined = shown[0] if len(shown) == 1 else " AND ".join(f"({s})" if " OR " in s else s for s in shown)
                        keep.append(i)
                        rows.append((len(hits), sorted({n for h in hits for n in h[3]}), joined, CLASSES[worst], worst <= WEAK))
                if rows:
                    n, names, shown, category, allowed = zip(*rows, strict=True)
                    yield pa.record_batch(
                        [batch.column("doc_id").take(pa.array(keep)), pa.array(n, pa.int32()), pa.array(names, pa.list_(pa.string())), pa.array(shown), pa.array(category), pa.array(allowed)],
                        names=["doc_id", "n_hits", "licenses", "expression", "category", "allowed"],
                    )

    source = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {kind}, n_hits int, licenses array<string>, expression string, category string, allowed boolean")
