"""Public license wordings in the markup of license_scan (fixed values).

The texts of MIT, BSD, ISC, zlib and Boost are whole; of the Unlicense there is the first
sentence of permission; Apache, GNU, Mozilla and Creative Commons works carry a notice,
which is what stands here.
"""

_BSD_BEGIN = """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: <<optional>> 1 <</optional>> Redistributions of source code must retain the <<optional>> above <</optional>>
copyright notice, this list of conditions and the following disclaimer. <<optional>> 2 <</optional>> Redistributions in binary
form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
other materials provided with the distribution.
"""
_BSD_NAMES = """
<<optional>> 3 <</optional>> Neither the name of <<any 1-16>> nor the names of <<any 1-4>> contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
_BSD_END = """
THIS SOFTWARE IS PROVIDED BY <<any 1-16>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<any 1-16>> BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""

TEMPLATES = {
    "mit": [
        """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
<<optional>> (the "Software") <</optional>>, to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
<<optional>> (including the next paragraph) <</optional>> shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<any 1-2>>. IN NO EVENT SHALL <<any 1-16>> BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
        "<<optional>> released <</optional>> under the <<optional>> terms of the <</optional>> MIT license",
        "licensed under the <<optional>> terms of the <</optional>> MIT license",
    ],
    "apache-2": [
        """
Licensed under the Apache License, Version 2.0 <<optional>> (the "License") <</optional>>; you may not use <<any 1-4>> except in
compliance with the License. You may obtain a copy of the License at <<any 1-12>> Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License.
""",
        "licensed under the <<optional>> terms of the <</optional>> Apache License Version 2.0",
        "licensed under the <<optional>> terms of the <</optional>> Apache License 2.0",
    ],
    "bsd-2": [_BSD_BEGIN + _BSD_END, "licensed under the BSD 2 clause license"],
    "bsd-3": [_BSD_BEGIN + _BSD_NAMES + _BSD_END, "licensed under the BSD 3 clause license"],
    "isc": [
        """
Permission to use, copy, modify, and <<optional>> or <</optional>> distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND <<any 1-16>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL <<any 1-16>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
""",
    ],
    "zlib": [
        """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<optional>> 1
<</optional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
<<optional>> 2 <</optional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. <<optional>> 3 <</optional>> This notice may not be removed or altered from any source distribution.
""",
    ],
    "boost": [
        """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative
works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated
by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND <<any 1-2>>. IN NO EVENT SHALL THE
COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
""",
        "distributed under the Boost Software License Version 1.0",
    ],
    "unlicense": [
        """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.
""",
    ],
    "gpl-3": [
        """
is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or <<any 1-6>> any later version.
""",
        """
licensed under the <<optional>> terms of the <</optional>> GNU General Public License <<optional>> as published by the Free
Software Foundation <</optional>> <<optional>> either <</optional>> version 3
""",
        "GNU General Public License v3",
    ],
    "gpl-2": [
        """
is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation; either version 2 of the License, or <<any 1-6>> any later version.
""",
        """
licensed under the <<optional>> terms of the <</optional>> GNU General Public License <<optional>> as published by the Free
Software Foundation <</optional>> <<optional>> either <</optional>> version 2
""",
        "GNU General Public License v2",
    ],
    "lgpl": [
        """
licensed under the <<optional>> terms of the <</optional>> GNU <<any 1-1>> General Public License <<optional>> as published by the
Free Software Foundation <</optional>> <<optional>> either <</optional>> version <<any 1-2>>
""",
    ],
    "mpl-2": [
        """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at <<any 1-8>>
""",
        "licensed under the Mozilla Public License Version 2.0",
    ],
    "cc-by-nc": [
        "licensed under <<any 0-4>> CC BY NC <<optional>> 4.0 <</optional>>",
        "licensed under a Creative Commons Attribution NonCommercial <<any 0-2>> License",
    ],
    "cc-by": [
        "licensed under a Creative Commons Attribution <<optional>> 4.0 <</optional>> <<optional>> International <</optional>> License",
        "licensed under CC BY 4.0",
    ],
    "reserved": ["all rights reserved"],
}
