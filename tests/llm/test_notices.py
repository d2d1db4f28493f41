"""Licence notices in the wordings that projects use."""

import pytest

from tunegrid.llm import licenses

BSD = """Copyright (c) 2020, Example Widgets Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
{}
"""
ENDORSE = "* Neither the name of {} nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.\n"
AUTHOR = "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n"
GPL = """{0} is free software{1} you can redistribute it and/or modify
it under the terms of the GNU {2} as published by
the Free Software Foundation, either version {3} of the License, or
(at your option) any later version.

{0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
NOTICES = [
    (BSD.format(""), "BSD-2-Clause"),
    (BSD.format(ENDORSE.format("Example Widgets Inc.")), "BSD-3-Clause"),
    (BSD.format(ENDORSE.format("the University")), "BSD-3-Clause"),
    (BSD.format(ENDORSE.format("the copyright holder")), "BSD-3-Clause"),
    (BSD.format(ENDORSE.format("Jane Roe, the Foo Project, its parent organisation")), "BSD-3-Clause"),
    (BSD.format(AUTHOR), "BSD-3-Clause"),
    (GPL.format("Foo", ":", "General Public License", 3), "GPL-3.0-or-later"),
    (GPL.format("This program", ";", "General Public License", 2), "GPL-2.0-or-later"),
    (GPL.format("The Bar Toolkit", ":", "Affero General Public License", 3), "AGPL-3.0-or-later"),
    (GPL.format("This library", ";", "Lesser General Public License", "2.1"), "LGPL-2.1-or-later"),
    (GPL.format("libbaz 2", ":", "Lesser General Public License", 3), "LGPL-3.0-or-later"),
    ("// SPDX-License-Identifier: Apache-2.0 OR MIT\nint x;", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: (MIT AND ISC) OR GPL-2.0-only\n", "GPL-2.0-only,ISC,MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 OR Apache-2.0", "Apache-2.0,GPL-2.0-only"),
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("The project is not licensed under the MIT license.", None),
    ("This software is no longer released under the Apache License, Version 2.0.", None),
    ("The code was never made available under the GPL v3.", None),
    ("The project is licensed under the MIT license.", "MIT"),
    ("Copyright 2021 Acme. All rights reserved.", "proprietary"),
    ("Copyright 2021 Acme. All rights reserved.\nThis project is licensed under the MIT license.", "MIT"),
    ("It is free software.", None),
    ("All software is distributed in the hope of money.", None),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(NOTICES)], "doc_id long, text string")
    return {r.doc_id: r.licenses for r in licenses.scan_licenses(docs).collect()}


@pytest.mark.parametrize("k", range(len(NOTICES)))
def test_notice(found, k):
    assert (found.get(k) or None) == NOTICES[k][1]
