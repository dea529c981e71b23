"""Wordings by which licence families are named, one per line, their short names, and sentences that name none."""

TEMPLATES = {
    "apache-2.0": """
Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Released under the Apache 2.0 license.
SPDX-License-Identifier: Apache-2.0
""",
    "mit": """
Released under the MIT License.
Licensed under the MIT license.
This project is distributed under the terms of the MIT License.
SPDX-License-Identifier: MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.
""",
    "bsd": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Released under the BSD 3-Clause License.
Licensed under the BSD 2-Clause license.
SPDX-License-Identifier: BSD-3-Clause
""",
    "gpl": """
This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
You should have received a copy of the GNU General Public License along with this program.
Licensed under the GNU GPL version 2.
SPDX-License-Identifier: GPL-3.0-or-later
""",
    "lgpl": """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.
You should have received a copy of the GNU Lesser General Public License along with this library.
Licensed under the GNU Lesser General Public License, version 2.1.
SPDX-License-Identifier: LGPL-2.1-or-later
""",
    "agpl": """
Licensed under the GNU Affero General Public License, version 3.
You should have received a copy of the GNU Affero General Public License along with this program.
SPDX-License-Identifier: AGPL-3.0-only
""",
    "mpl-2.0": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/
Released under the Mozilla Public License, version 2.0.
SPDX-License-Identifier: MPL-2.0
""",
    "cc-by": """
This work is licensed under a Creative Commons Attribution 4.0 International License.
Licensed under CC BY 4.0.
Content is available under CC BY 3.0.
""",
    "cc-by-sa": """
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Licensed under CC BY-SA 4.0.
Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.
""",
    "cc-by-nc": """
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
Licensed under CC BY-NC 4.0.
Licensed under CC BY-NC-SA 4.0.
""",
    "cc0": """
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
Released under CC0 1.0 Universal.
This work is dedicated to the public domain under CC0.
""",
    "unlicense": """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
SPDX-License-Identifier: Unlicense
""",
    "isc": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
Released under the ISC License.
SPDX-License-Identifier: ISC
""",
}

#: What stands for a family in a short declaration.
NAMES = {
    "apache-2.0": ("Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0"),
    "mit": ("MIT",),
    "bsd": ("BSD", "BSD-3-Clause", "BSD-2-Clause", "BSD 3-Clause"),
    "gpl": ("GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GNU GPL", "GNU General Public License"),
    "lgpl": ("LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "GNU LGPL"),
    "agpl": ("AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL"),
    "mpl-2.0": ("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0"),
    "cc-by": ("CC-BY-4.0", "CC BY 4.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    "cc-by-nc": ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    "cc0": ("CC0", "CC0-1.0"),
    "unlicense": ("Unlicense",),
    "isc": ("ISC",),
}

#: Short declarations of a licence by its name.
FRAMES = (
    "License: {}", "Licence: {}", "licensed under {}", "licensed under the {} license", "released under the {} license", "released under {}",
    "distributed under the {} license", "distributed under {}", "available under {}", "available under the {} license",
    "under the terms of the {} license", "see the {} license", "SPDX-License-Identifier: {}",
)

NO_LICENCE = """
You need a driver's license to drive in this state.
The software license agreement was signed by both parties last week.
Licensed professionals must renew their license every year.
All rights reserved by the publisher of this magazine.
The general public was asked to attend the meeting at the university.
Version 2.0 of the program was released under a new name.
The Apache helicopter was released from service.
She studied at MIT before she joined the foundation.
You should have received a copy of the report along with this letter.
The terms of the agreement may be found in the attached copy.
Free software is used in schools without charge.
Permission is granted to enter the building after the notice.
A copy of the conditions was published in the list above.
The work was distributed to the members of the public library.
"""
