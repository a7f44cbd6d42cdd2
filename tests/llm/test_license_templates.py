"""Notices side by side, and the production templates of the license scan."""

from docquarry.llm.licenses import op4_license_scan, scan


def found(spark, tmp_path, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return [r.licenses for r in op4_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()]


def test_notices_side_by_side_do_not_compete(spark):
    gpl = "work is licensed under the GNU General Public License, version"
    texts = [f"The {gpl} 2. Released under the MIT License.", f"This {gpl} 2", f"Released under the MIT License. This {gpl}. Released under the ISC License."]
    texts += ["Released under the MIT License. " + f"The {gpl} 3. " * 40 + f"This {gpl} 2."]
    d = spark.createDataFrame([*enumerate(texts), (9, texts[1]), (9, f"The {gpl} 3")], "doc_id long, text string")
    got = {}
    for r in scan(d).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert got == {0: {"GPL-2.0", "MIT"}, 1: {"GPL-2.0"}, 2: {"MIT", "GPL-2.0", "GPL-3.0", "ISC"}, 3: {"MIT", "GPL-2.0", "GPL-3.0"}, 9: {"GPL-2.0", "GPL-3.0"}}


def test_production_templates(spark, tmp_path):
    gnu = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
    cases = [
        ("Copyright 2020 A. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so", "MIT"),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: * Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. * Neither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache-2.0"),
        (gnu.format("program", "General Public License", "2"), "GPL-2.0"),
        (gnu.format("program", "General Public License", "3"), "GPL-3.0"),
        (gnu.format("library", "Lesser General Public License", "2.1"), "LGPL-2.1"),
        (gnu.format("program", "Affero General Public License", "3"), "AGPL-3.0"),
        ("This project is licensed under the MIT License - see LICENSE", "MIT"),
        ("made available under CC BY 3.0 by us", "CC-BY-3.0"),
        ("under the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
        ("// SPDX-License-Identifier: MIT\nint main", "MIT"),
        ("/* SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) AND LGPL-2.1+ */", "BSD-3-Clause,GPL-2.0,LGPL-2.1"),
        ("a b SPDX-License-Identifier: Unknown-1.0 MIT", ""),
        ("The MIT campus is licensed to serve food under the county rules", ""),
    ]
    assert found(spark, tmp_path, [t for t, _ in cases]) == [x for _, x in cases]
