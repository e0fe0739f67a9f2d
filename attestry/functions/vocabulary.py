"""The vocabulary: names, synonyms, addresses and grants, as small literal maps that Catalyst folds into the plan.

A full published identifier list can be given to `Vocabulary`; without one, the identifiers are those named below.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identifiers known without a list.
IDENTIFIERS = (
    "0BSD", "AFL-3.0", "AGPL-1.0-only", "AGPL-1.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0",
    "BSD-1-Clause", "BSD-2-Clause", "BSD-2-Clause-Views", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "Bitstream-Vera", "BlueOak-1.0.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-PDDC", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "Clips", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-1.0-only",
    "GPL-1.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "NIST-PD", "OLDAP-2.8",
    "OFL-1.1", "PSF-2.0", "Python-2.0", "Ruby", "Unicode-3.0", "Unlicense", "W3C-19980720", "WTFPL", "X11", "XFree86-1.1", "ZPL-2.1", "Zlib", "curl",
    "libpng-2.0", "libselinux-1.0",
)
# Identifiers that are no longer current, and so resolve elsewhere or stay references.
DEPRECATED = (
    "AGPL-1.0", "AGPL-3.0", "GPL-1.0", "GPL-1.0+", "GPL-2.0", "GPL-2.0+", "GPL-3.0", "GPL-3.0+", "LGPL-2.0", "LGPL-2.0+", "LGPL-2.1", "LGPL-2.1+",
    "LGPL-3.0", "LGPL-3.0+", "Nunit", "wxWindows",
)
# Names that classifiers use for identifiers.
CLASSIFIER_NAMES = {
    "Apache-with-LLVM-Exception": "Apache-2.0 WITH LLVM-exception",
    "BSD-0-Clause": "0BSD",
    "BSD-2-Clause-FreeBSD": "BSD-2-Clause-Views",
    "BSD-2-Clause-NetBSD": "BSD-2-Clause",
    "Business-Source-License-1.1": "BUSL-1.1",
    "CLIPS": "Clips",
    "OpenLDAP": "OLDAP-2.8",
    "PNG": "libpng-2.0",
    "cURL": "curl",
}
# Classifier names that no list holds; they stay references even where a synonym might seem to fit.
UNLISTED = (
    "ANTLR", "AdColony-SDK", "Android-SDK", "Apache-2.0-Modified", "Apache-with-Runtime-Exception", "Atmel", "Autodesk-3D-Studio-File-Toolkit", "BCL",
    "BLAS", "BSD-2-Clause-Flex", "BSD-3-Clause-OpenMPI", "BSD-FatFs", "BSD-No-Other-Rights", "BSD-Rice", "BabelstoneIDS", "BeOpen", "Bitstream",
    "Boost-original", "CERN-OHL-WR-v2", "CERN-OHL-v1.2", "Cloud-Pre-GA", "Commons-Clause", "DBAD", "Entenssa", "FFT2D", "Facebook-2-Clause",
    "Facebook-3-Clause", "Facebook-Examples", "GD-Graphic-Library", "GIAJWTOU-2.0", "GIF-Encoder", "GNU-All-permissive-Copying-License",
    "GUST-Font-License", "GenericIntel", "HTK", "IDA", "InnerNet", "JTidy", "JasPer", "KUKA", "Khronos", "Khronos_OpenCL", "LZMA",
    "Lattice-Semiconductor", "LicenseRef-C-Ares", "LicenseRef-MIT-Lucent", "LicenseRef-Nordic-binary", "LicenseRef-SendMail", "LicenseRef-iccjpeg",
    "LicenseRef-nacl", "LicenseRef-takuya-ooura", "LicenseRef-uthash", "Lil-1.0", "MTK", "NCBI", "NREL", "OROMatcher", "Open-Game-License-1.0a",
    "Oracle-Open-Symphony", "PIL", "PPP", "Python-2.0-complete", "RCSB-PDB", "RSA", "Rijndael-3.0", "SPL-SQRT-FLOOR", "SQLite", "Sflow", "TPM-2",
    "Tensilica", "UFL-1.0", "USGovernment", "VMAC", "Waymo1P", "Windows-SDK-10", "WordNet-3.0", "X11-Lucent", "XZ", "Xcode", "Zendesk", "aopalliance",
    "bzip2", "dso", "geant4", "getopt", "pffft", "re2c", "tcl_tk", "unicode_org", "wxWindows-3.1",
)
# Licences whose text doesn't say whether later versions are granted.
GRANT_BASES = ("AGPL-1.0", "AGPL-3.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")
# The same with an exception: name → (base, exception).
GRANT_EXCEPTIONS = {
    "GPL-2.0-with-GCC-exception": ("GPL-2.0", "GCC-exception-2.0"),
    "GPL-2.0-with-autoconf-exception": ("GPL-2.0", "Autoconf-exception-2.0"),
    "GPL-2.0-with-bison-exception": ("GPL-2.0", "Bison-exception-2.2"),
    "GPL-2.0-with-classpath-exception": ("GPL-2.0", "Classpath-exception-2.0"),
    "GPL-2.0-with-font-exception": ("GPL-2.0", "Font-exception-2.0"),
    "GPL-3.0-with-GCC-exception": ("GPL-3.0", "GCC-exception-3.1"),
    "GPL-3.0-with-autoconf-exception": ("GPL-3.0", "Autoconf-exception-3.0"),
    "GPL-3.0-with-bison-exception": ("GPL-3.0", "Bison-exception-2.2"),
}
# What each wording of a notice grants: (name, wording, grant).
HEADER_VARIANTS = (
    ("AGPL-3.0", "header.txt", "AGPL-3.0-or-later"),
    ("GPL-1.0", "a.txt", "GPL-1.0-or-later"),
    ("GPL-1.0", "b.txt", "GPL-1.0-or-later"),
    ("GPL-2.0", "a.txt", "GPL-2.0-or-later"),
    ("GPL-2.0", "b.txt", "GPL-2.0-or-later"),
    ("GPL-2.0", "c.txt", "GPL-2.0-or-later"),
    ("GPL-2.0", "d.txt", "GPL-2.0-or-later"),
    ("GPL-2.0", "e.txt", "GPL-2.0-only"),
    ("GPL-2.0", "f.txt", "GPL-2.0-only"),
    ("GPL-2.0", "g.txt", "GPL-2.0-only"),
    ("GPL-2.0", "h.txt", "GPL-2.0-only"),
    ("GPL-2.0", "header.txt", "GPL-2.0-or-later"),
    ("GPL-2.0", "i.txt", "GPL-2.0-only"),
    ("GPL-2.0", "j.txt", "GPL-2.0-only"),
    ("GPL-2.0", "k.txt", "GPL-2.0-only"),
    ("GPL-2.0-with-autoconf-exception", "a.txt", "GPL-2.0-or-later WITH Autoconf-exception-2.0"),
    ("GPL-2.0-with-autoconf-exception", "b.txt", "GPL-2.0-or-later WITH Autoconf-exception-2.0"),
    ("GPL-2.0-with-autoconf-exception", "header.txt", "GPL-2.0-or-later WITH Autoconf-exception-2.0"),
    ("GPL-2.0-with-classpath-exception", "header.txt", "GPL-2.0-only WITH Classpath-exception-2.0"),
    ("GPL-3.0", "a.txt", "GPL-3.0-only"),
    ("GPL-3.0", "b.txt", "GPL-3.0-only"),
    ("GPL-3.0", "header.txt", "GPL-3.0-or-later"),
    ("GPL-3.0-with-autoconf-exception", "a.txt", "GPL-3.0-or-later WITH Autoconf-exception-3.0"),
    ("GPL-3.0-with-autoconf-exception", "header.txt", "GPL-3.0-or-later WITH Autoconf-exception-3.0"),
    ("GPL-3.0-with-bison-exception", "header.txt", "GPL-3.0-or-later WITH Bison-exception-2.2"),
    ("LGPL-2.0", "a.txt", "LGPL-2.0-or-later"),
    ("LGPL-2.0", "header.txt", "LGPL-2.0-only"),
    ("LGPL-2.1", "a.txt", "LGPL-2.1-or-later"),
    ("LGPL-2.1", "b.txt", "LGPL-2.1-or-later"),
    ("LGPL-2.1", "c.txt", "LGPL-2.1-only"),
    ("LGPL-2.1", "d.txt", "LGPL-2.1-only"),
    ("LGPL-2.1", "header.txt", "LGPL-2.1-or-later"),
    ("LGPL-2.1", "qt_dual.txt", "LGPL-2.1-only"),
    ("LGPL-2.1", "qt_toolkit.txt", "LGPL-2.1-only"),
    ("LGPL-3.0", "a.txt", "LGPL-3.0-or-later"),
    ("LGPL-3.0", "b.txt", "LGPL-3.0-only"),
    ("LGPL-3.0", "header.txt", "LGPL-3.0-only"),
)
# Normalised wordings that name one licence.
SYNONYMS = {
    "the apache software license version 2 0": "Apache-2.0",
    "apache software license version 2 0": "Apache-2.0",
    "apache license version 2 0": "Apache-2.0",
    "the apache license version 2 0": "Apache-2.0",
    "apache public license 2 0": "Apache-2.0",
    "apache 2": "Apache-2.0",
    "apache 2 0": "Apache-2.0",
    "asl 2 0": "Apache-2.0",
    "the mit license": "MIT",
    "mit license": "MIT",
    "the mit license mit": "MIT",
    "the bsd 3 clause license": "BSD-3-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "new bsd license": "BSD-3-Clause",
    "the new bsd license": "BSD-3-Clause",
    "modified bsd license": "BSD-3-Clause",
    "bsd 2 clause license": "BSD-2-Clause",
    "simplified bsd license": "BSD-2-Clause",
    "the bsd 2 clause license": "BSD-2-Clause",
    "eclipse public license v2 0": "EPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
    "eclipse public license v 2 0": "EPL-2.0",
    "epl 2 0": "EPL-2.0",
    "eclipse public license v1 0": "EPL-1.0",
    "eclipse public license 1 0": "EPL-1.0",
    "epl 1 0": "EPL-1.0",
    "eclipse distribution license v1 0": "BSD-3-Clause",
    "eclipse distribution license v 1 0": "BSD-3-Clause",
    "eclipse distribution license edl 1 0": "BSD-3-Clause",
    "edl 1 0": "BSD-3-Clause",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "common development and distribution license 1 0 cddl": "CDDL-1.0",
    "common development and distribution license cddl v1 0": "CDDL-1.0",
    "cddl 1 0": "CDDL-1.0",
    "cddl 1 1": "CDDL-1.1",
    "python software foundation license": "PSF-2.0",
    "psf license": "PSF-2.0",
    "python license": "Python-2.0",
    "zope public license": "ZPL-2.1",
}
# Full names and addresses of the commonest identifiers, as the published list gives them.
NAMES = {"apache license 2 0": "Apache-2.0"}
ADDRESSES = {
    "apache.org/licenses/license-2.0": "Apache-2.0",
    "opensource.org/licenses/apache-2.0": "Apache-2.0",
    "opensource.org/licenses/mit": "MIT",
    "opensource.org/license/mit": "MIT",
    "opensource.org/licenses/bsd-3-clause": "BSD-3-Clause",
    "eclipse.org/legal/epl-2.0": "EPL-2.0",
    "mozilla.org/mpl/2.0": "MPL-2.0",
}


def literal_map(values: dict[str, str]) -> Column:
    """A constant map; Catalyst folds it. Only for tables of fixed, small size."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair)) if values else F.create_map().cast("map<string,string>")


def look_up(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(values), key) if values else F.lit(None).cast("string")


@dataclass(frozen=True)
class Vocabulary:
    identifiers: tuple[str, ...] = IDENTIFIERS
    deprecated: tuple[str, ...] = DEPRECATED
    names: dict[str, str] = field(default_factory=lambda: dict(NAMES))
    addresses: dict[str, str] = field(default_factory=lambda: dict(ADDRESSES))

    @cached_property
    def current(self) -> dict[str, str]:
        """Lower-cased → as listed."""
        return {i.lower(): i for i in self.identifiers}

    @cached_property
    def grants(self) -> dict[str, tuple[str, str, str]]:
        """Name → (base, only, or later)."""
        plain = {b: (b, f"{b}-only", f"{b}-or-later") for b in GRANT_BASES}
        return plain | {n: (b, f"{b}-only WITH {x}", f"{b}-or-later WITH {x}") for n, (b, x) in GRANT_EXCEPTIONS.items()}

    @cached_property
    def header_grants(self) -> dict[str, str]:
        """name/variant → what the wording grants."""
        return {f"{name}/{wording}": grant for name, wording, grant in HEADER_VARIANTS}

    @classmethod
    def from_list(cls, licenses: list[dict]) -> Vocabulary:
        """From the entries of a published list: licenseId, name, isDeprecatedLicenseId, seeAlso. An address or a name of two licences names neither."""
        from attestry.functions.spdx import plain_text, plain_url

        now = [x for x in licenses if not x.get("isDeprecatedLicenseId")]
        urls: dict[str, set[str]] = {}
        names: dict[str, set[str]] = {}
        for x in now:
            if n := plain_text(x.get("name") or ""):
                names.setdefault(n, set()).add(x["licenseId"])
            for u in x.get("seeAlso", ()):
                if p := plain_url(u):
                    urls.setdefault(p, set()).add(x["licenseId"])
        return cls(
            tuple(x["licenseId"] for x in now),
            tuple(x["licenseId"] for x in licenses if x.get("isDeprecatedLicenseId")),
            {n: next(iter(i)) for n, i in names.items() if len(i) == 1},
            {u: next(iter(i)) for u, i in urls.items() if len(i) == 1},
        )
