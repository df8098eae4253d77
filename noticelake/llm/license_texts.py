"""Whole texts of public licences, as words in lower case without names and years, with the phrases that each must hold.

Fixed values: the licences' published wordings.
"""

from __future__ import annotations

TEXTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit-text": (
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is
        without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and
        noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
        ("permission is hereby granted free of charge", "distribute sublicense and or sell copies", "shall be included in all copies or substantial portions"),
    ),
    "isc": (
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above
        copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard
        to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct
        indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence
        or other tortious action arising out of or in connection with the use or performance of this software""",
        ("permission to use copy modify and or distribute this software", "appear in all copies", "disclaims all warranties"),
    ),
    "bsd-2": (
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1
        redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in
        binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied
        warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed""",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice", "must reproduce the above copyright notice"),
    ),
    "apache-2-notice": (
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy
        of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the
        license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license""",
        ("licensed under the apache license", "except in compliance with the license", "unless required by applicable law"),
    ),
    "gpl-3-notice": (
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
        free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will
        be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general
        public license for more details""",
        ("is free software you can redistribute it", "either version 3 of the license", "in the hope that it will be useful"),
    ),
    "mpl-2-notice": (
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you
        can obtain one at http mozilla org mpl 2 0""",
        ("source code form is subject to the terms", "if a copy of the mpl was not distributed"),
    ),
    "unlicense": (
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means""",
        ("free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile"),
    ),
    "zlib": (
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from
        the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you
        wrote the original software""",
        ("without any express or implied warranty", "to alter it and redistribute it freely", "the origin of this software must not be misrepresented"),
    ),
}
