"""Licence wordings with template markup.

Markup: ``<<optional>> ... <<end>>`` may be absent, ``<<var 0 30>>`` stands for
so many words of any kind, ``<<either a b|c>>`` for one of the given wordings.
Case, marks and line breaks do not count. Leading and trailing replaceable
regions only widen a match.
"""

# Public licence wordings and their usual short names.
TEMPLATES: list[tuple[str, str]] = [
    (
        "mit",
        """<<optional>>The MIT License <<optional>>MIT<<end>><<end>> <<optional>>Copyright <<var 1 30>><<end>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<optional>>(including the next paragraph)<<end>> shall be
        included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
        THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<either NONINFRINGEMENT|NON INFRINGEMENT>>.
        IN NO EVENT SHALL <<either THE AUTHORS OR COPYRIGHT HOLDERS|<<var 1 20>>>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """<<optional>>ISC License<<end>> <<optional>>Copyright <<var 1 30>><<end>> Permission to use, copy, modify, and/or distribute
        this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and
        this permission notice appear in all copies.""",
    ),
    (
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<optional>><<either 1|a>><<end>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. <<optional>><<either 2|b>><<end>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
    (
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<optional>><<either 1|a>><<end>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. <<optional>><<either 2|b>><<end>>
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution.
        <<optional>><<either 3|c>><<end>> Neither the name of <<var 1 20>> nor the names of <<either its|<<var 1 10>>>> contributors
        may be used to endorse or promote products derived from this software without specific prior written permission.""",
    ),
    (
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 <<optional>>(the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0<<end>>""",
    ),
    (
        "gpl-2.0-or-later",
        """<<either This program|<<var 1 6>>>> is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version.""",
    ),
    (
        "gpl-3.0-or-later",
        """<<either This program|<<var 1 6>>>> is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    ),
    ("gpl-2.0", "<<either licensed|released|distributed>> under the <<either GNU|terms of the GNU>> General Public License version 2 <<optional>>0<<end>>"),
    ("gpl-3.0", "<<either licensed|released|distributed>> under the <<either GNU|terms of the GNU>> General Public License version 3 <<optional>>0<<end>>"),
    ("lgpl", "<<either licensed|released|distributed>> under the <<either GNU|terms of the GNU>> <<either Lesser|Library>> General Public License <<optional>>version <<var 1 2>><<end>>"),
    ("mit", "<<either licensed|released|distributed>> under the <<optional>>terms of the<<end>> MIT License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("cc-by-4.0", "<<either licensed|released|distributed>> under <<optional>><<either a|the>><<end>> <<either CC BY|Creative Commons Attribution>> 4.0 <<optional>>International<<end>>"),
    ("cc-by-sa-4.0", "<<either licensed|released|distributed>> under <<optional>><<either a|the>><<end>> <<either CC BY SA|Creative Commons Attribution ShareAlike>> 4.0 <<optional>>International<<end>>"),
    (
        "cc-by-nc-4.0",
        "<<either licensed|released|distributed>> under <<optional>><<either a|the>><<end>> <<either CC BY NC|Creative Commons Attribution NonCommercial>> 4.0 <<optional>>International<<end>>",
    ),
    ("cc0-1.0", "<<either CC0 1.0|CC0 1.0 Universal>> <<optional>>Public Domain Dedication<<end>>"),
]
