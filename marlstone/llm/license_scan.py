"""License scan by ordered signature rules.

Rules are regular expressions over a text's words joined by single spaces. Each has a priority, a
confidence and the keywords without which it cannot match; an automaton finds the keywords that a text
has, and only rules whose keywords are all there are tried. Of overlapping detections one that lies within
a detection of higher priority (or of the same priority and greater length) is suppressed.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import slices, text_of

#: Phrases whose places are always counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

_V = r"(?: version| v)?"
_GPL = r"(?:gnu )?general public licen[sc]e|(?:gnu )?gpl"
_OR = r"(?: (?:only|or (?:any )?later(?: version)?))?"
#: label, pattern of the name, words that the pattern cannot do without.
FAMILIES = (
    ("mit", r"(?:mit|expat)(?: x11)?", ""), ("mit-0", r"mit no attribution|mit 0", "mit"), ("x11", r"x11(?: mit)?", "x11"),
    ("apache-2", rf"(?:the )?apache(?: software)?(?: licen[sc]e)?{_V} 2(?: 0)?", "apache"), ("apache-1.1", rf"apache(?: software)?(?: licen[sc]e)?{_V} 1 1", "apache"), ("apache-1", rf"apache(?: software)?(?: licen[sc]e)?{_V} 1 0", "apache"),
    ("gpl-1", rf"(?:{_GPL}){_V} 1(?: 0)?{_OR}", ""), ("gpl-2", rf"(?:{_GPL}){_V} 2(?: 0)?{_OR}", ""), ("gpl-3", rf"(?:{_GPL}){_V} 3(?: 0)?{_OR}", ""),
    ("lgpl-2", rf"(?:gnu )?(?:(?:library|lesser) general public licen[sc]e|lgpl){_V} 2(?: 0)?{_OR}", ""), ("lgpl-2.1", rf"(?:gnu )?(?:lesser general public licen[sc]e|lgpl){_V} 2 1{_OR}", ""), ("lgpl-3", rf"(?:gnu )?(?:lesser general public licen[sc]e|lgpl){_V} 3(?: 0)?{_OR}", ""),
    ("agpl-3", rf"(?:gnu )?(?:affero general public licen[sc]e|agpl){_V} 3(?: 0)?{_OR}", ""), ("gfdl", rf"(?:gnu )?(?:free documentation licen[sc]e|gfdl|fdl)(?:{_V} 1 [1-3])?", ""),
    ("bsd-2", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd|freebsd)", "bsd"), ("bsd-3", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd"), ("bsd-4", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd"), ("bsd-0", r"(?:bsd zero clause|zero clause bsd|0bsd)", "bsd"),
    ("isc", r"isc", "isc"), ("mpl-1.1", rf"(?:mozilla public licen[sc]e|mpl){_V} 1 1", ""), ("mpl-2", rf"(?:mozilla public licen[sc]e|mpl){_V} 2(?: 0)?", ""),
    ("epl-1", rf"(?:eclipse public licen[sc]e|epl){_V} 1(?: 0)?", ""), ("epl-2", rf"(?:eclipse public licen[sc]e|epl){_V} 2(?: 0)?", ""), ("cddl-1", rf"(?:common development and distribution licen[sc]e|cddl)(?:{_V} 1(?: [01])?)?", ""),
    ("cpl-1", rf"common public licen[sc]e(?:{_V} 1(?: 0)?)?", "common"), ("eupl-1.2", rf"(?:european union public licen[sc]e|eupl){_V} 1 2", ""), ("eupl-1.1", rf"(?:european union public licen[sc]e|eupl){_V} 1 1", ""),
    ("artistic-1", rf"artistic(?: licen[sc]e)?{_V} 1(?: 0)?", "artistic"), ("artistic-2", rf"artistic(?: licen[sc]e)?{_V} 2(?: 0)?", "artistic"), ("zlib", r"zlib(?: libpng)?", "zlib"), ("libpng", r"libpng", "libpng"), ("bsl-1", rf"boost software(?: licen[sc]e)?(?:{_V} 1(?: 0)?)?", "boost"), ("busl-1.1", r"business source(?: licen[sc]e)?(?: 1 1)?", "business"),
    ("unlicense", r"(?:the )?unlicense", "unlicense"), ("wtfpl", r"wtfpl|do what the fuck you want to public licen[sc]e", ""), ("cc0-1", r"(?:cc0|creative commons zero)(?: 1 0)?(?: universal)?", ""), ("pddl", r"(?:open data commons )?public domain dedication", "domain"),
    ("cc-by", r"(?:creative commons attribution|cc by)(?: [1-4] \d)?(?: (?:international|unported))?", ""), ("cc-by-sa", r"(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] \d)?(?: (?:international|unported))?", ""),
    ("cc-by-nc", r"(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] \d)?(?: (?:international|unported))?", ""), ("cc-by-nd", r"(?:creative commons attribution no ?deriv(?:ative)?s?|cc by nd)(?: [1-4] \d)?", ""),
    ("cc-by-nc-sa", r"(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] \d)?", ""), ("cc-by-nc-nd", r"(?:creative commons attribution non ?commercial no ?deriv(?:ative)?s?|cc by nc nd)(?: [1-4] \d)?", ""),
    ("odbl", r"(?:open database licen[sc]e|odbl)(?: 1 0)?", ""), ("odc-by", r"(?:open data commons attribution|odc by)(?: 1 0)?", ""), ("ofl-1.1", r"(?:sil )?open font licen[sc]e(?: 1 1)?|ofl 1 1", ""), ("python-2", r"(?:python software foundation|psf)(?: licen[sc]e)?(?: 2)?", ""), ("ruby", r"ruby", "ruby"), ("php-3", r"php(?: licen[sc]e)?(?: 3(?: 0[01])?)", "php"),
    ("postgresql", r"postgresql", "postgresql"), ("openssl", r"openssl", "openssl"), ("ms-pl", r"microsoft public|ms pl", ""), ("ms-rl", r"microsoft reciprocal|ms rl", ""), ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", "ncsa"), ("upl-1", r"universal permissive(?: licen[sc]e)?(?: 1 0)?|upl 1 0", ""), ("afl-3", rf"academic free(?: licen[sc]e)?{_V} 3(?: 0)?", "academic"), ("osl-3", rf"open software(?: licen[sc]e)?{_V} 3(?: 0)?", "software"),
    ("sspl-1", r"server side public(?: licen[sc]e)?(?: 1)?|sspl(?: 1)?", ""), ("elastic-2", r"elastic(?: licen[sc]e)?(?: 2(?: 0)?)", "elastic"), ("vim", r"vim", "vim"), ("curl", r"curl", "curl"), ("llama", r"llama (?:[23]|3 1|3 2) community", "llama"), ("openrail-m", r"(?:bigscience )?open ?rail(?: m)?", ""),
)
#: What stands around a name: pattern, priority, confidence, words needed.
FRAMES = (
    (r"spdx licen[sc]e identifier (?:{})", 90, 0.99, "spdx"),
    (r"(?:is |are )?licen[sc]ed under (?:the )?(?:terms of (?:the )?)?(?:{})(?: licen[sc]e)?", 80, 0.95, "under"),
    (r"(?:released|distributed|published|available|provided|shared) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{})(?: licen[sc]e)?", 80, 0.95, "under"),
    (r"(?:under|subject to) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:{}) licen[sc]e", 70, 0.9, ""),
    (r"licen[sc]e (?:{})", 60, 0.8, ""),
    (r"(?:the )?(?:{}) licen[sc]e", 50, 0.7, ""),
)
#: Names that tell the license by themselves: no frame is needed.
PLAIN = ("apache-2", "gpl-1", "gpl-2", "gpl-3", "lgpl-2", "lgpl-2.1", "lgpl-3", "agpl-3", "mpl-2", "mpl-1.1", "epl-1", "epl-2", "cddl-1", "eupl-1.1", "eupl-1.2", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "cc0-1", "odbl", "ofl-1.1", "bsd-2", "bsd-3", "bsd-4", "bsd-0")
#: Sentences of license texts.
SENTENCES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "hereby"), ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("bsd-3", r"neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "endorse"), ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "liable"), ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("public-domain", r"(?:released|dedicated|placed|put) (?:in|into|to) the public domain", "domain"), ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", "redistribute"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", "redistribute"), ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies", "verbatim"),
    ("proprietary", r"all rights reserved", "reserved"), ("proprietary", r"proprietary and confidential", "proprietary"), ("proprietary", r"unauthorized copying of this file", "unauthorized"), ("non-commercial", r"for non ?commercial use only", "commercial"), ("research-only", r"for research (?:purposes|use) only", "research"),
    # Notices and clauses of license texts, by license.
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "substantial"), ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell", "sublicense"),
    ("mit-0", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", "furnished"),
    ("x11", r"except as contained in this notice the name of .{1,80}? shall not be used in advertising", "advertising"), ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "disclaims"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and without fee )?is hereby granted", "hereby"), ("hpnd", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", "publicity"),
    ("bsd-2", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions"), ("bsd-2", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "redistributions"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising"), ("bsd", r"this software is provided by the (?:copyright holders?|regents|authors?)(?: and contributors)? as is and any express or implied warranties", "express"),
    ("bsd", r"in no event shall the (?:copyright (?:holder|owner)|regents|authors?)(?: or contributors)? be liable for any direct indirect incidental special exemplary or consequential damages", "exemplary"), ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd-3-lbnl", r"you are under no obligation whatsoever to provide any bug fixes patches or upgrades to the features functionality or performance", "obligation"), ("bsd-3-clear", r"no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e", "patent"),
    ("apache-2", r"you may not use this file except in compliance with the licen[sc]e", "compliance"), ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", "applicable"),
    ("apache-2", r"licensed to the apache software foundation asf under one or more contributor licen[sc]e agreements", "apache"), ("apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e", "irrevocable"),
    ("apache-2", r"the asf licenses this file to you under the apache licen[sc]e", "asf"), ("apache-2", r"http www apache org licen[sc]es licen[sc]e 2 0", "apache"), ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache"), ("apache-1.1", r"products derived from this software may not be called apache", "apache"),
    ("gpl", r"you should have received a copy of the gnu general public licen[sc]e along with (?:this program|this library|this software)", "gnu"), ("gpl", r"either version [123](?: 0)? of the licen[sc]e or at your option any later version", "option"), ("gpl-2", r"either version 2 of the licen[sc]e or at your option any later version", "option"),
    ("gpl-3", r"either version 3 of the licen[sc]e or at your option any later version", "option"), ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "hope"), ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e", "merchantability"),
    ("gpl-2", r"gnu general public licen[sc]e version 2 june 1991", "june"), ("gpl-3", r"gnu general public licen[sc]e version 3 29 june 2007", "june"), ("gpl-1", r"gnu general public licen[sc]e version 1 february 1989", "february"), ("gpl-2", r"free software foundation inc 5[19] (?:franklin street|temple place)", "foundation"),
    ("gpl-2", r"the precise terms and conditions for copying distribution and modification follow", "precise"), ("gpl-3", r"the gnu general public licen[sc]e is a free copyleft licen[sc]e for software and other kinds of works", "copyleft"), ("gpl-2-classpath", r"linking this library statically or dynamically with other modules is making a combined work based on this library", "statically"),
    ("gpl-classpath", r"as a special exception the copyright holders of this library give you permission to link this library with independent modules", "exception"), ("gpl-openssl", r"permission to link the (?:code|program) (?:of portions of this program )?with the openssl library", "openssl"), ("gpl-font", r"this font does not by itself cause the resulting document to be covered by the gnu general public licen[sc]e", "font"),
    ("gpl-bison", r"you may create a larger work that contains part or all of the bison parser skeleton", "bison"), ("gpl-autoconf", r"part of the output of autoconf when autoconf processes", "autoconf"), ("gcc-exception", r"gcc runtime library exception", "gcc"), ("linux-syscall", r"this copyright does not cover user programs that use kernel services by normal system calls", "kernel"),
    ("lgpl", r"you should have received a copy of the gnu lesser general public licen[sc]e along with", "lesser"), ("lgpl-2.1", r"gnu lesser general public licen[sc]e version 2 1 february 1999", "february"), ("lgpl-2", r"gnu library general public licen[sc]e version 2 june 1991", "library"), ("lgpl-3", r"this version of the gnu lesser general public licen[sc]e incorporates the terms and conditions of version 3", "incorporates"),
    ("lgpl", r"this library is distributed in the hope that it will be useful but without any warranty", "hope"), ("lgpl", r"a work that uses the library in isolation is not a derivative work of the library", "derivative"), ("agpl-3", r"gnu affero general public licen[sc]e version 3 19 november 2007", "affero"), ("agpl-3", r"if your software can interact with users remotely through a computer network", "remotely"),
    ("agpl", r"you should have received a copy of the gnu affero general public licen[sc]e along with", "affero"), ("agpl-3", r"remote network interaction use with the gnu general public licen[sc]e", "interaction"), ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", "documentation"),
    ("gfdl-1.3", r"with no invariant sections no front cover texts and no back cover texts", "invariant"), ("mpl-2", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0", "mozilla"), ("mpl-2", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl"), ("mpl-2", r"incompatible with secondary licen[sc]es", "incompatible"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public licen[sc]e version 1 1", "mozilla"), ("mpl-1.1", r"alternatively the contents of this file may be used under the terms of either the gnu general public licen[sc]e version 2 or later", "alternatively"), ("npl-1.1", r"the contents of this file are subject to the netscape public licen[sc]e", "netscape"),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v(?:ersion)? ?1 0", "eclipse"), ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v(?:ersion)? ?)?2 0", "eclipse"), ("epl-2", r"this source code may also be made available under the following secondary licen[sc]es", "secondary"),
    ("cpl-1", r"accompanying program is provided under the terms of this common public licen[sc]e", "common"), ("cddl-1", r"the contents of this file are subject to the terms of the common development and distribution licen[sc]e", "development"), ("cddl-1", r"when distributing covered code include this cddl header", "cddl"), ("eupl-1.2", r"licensed under the eupl version 1 2 or as soon they will be approved by the european commission", "eupl"),
    ("eupl", r"you may not use this work except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at", "obtain"), ("osl-3", r"licensed under the open software licen[sc]e version 3 0", "open"), ("afl-3", r"licensed under the academic free licen[sc]e version 3 0", "academic"), ("artistic-1", r"the intent of this document is to state the conditions under which a package may be copied", "intent"),
    ("artistic-2", r"this licen[sc]e establishes the terms under which a given free software package may be copied modified distributed and or redistributed", "establishes"), ("artistic", r"this is free software you can redistribute it and or modify it under the (?:same )?terms (?:as|of) (?:the )?(?:perl|artistic)", "redistribute"), ("perl", r"under the same terms as perl(?: 5)? itself", "perl"),
    ("ruby", r"you can redistribute it and or modify it under either the terms of the 2 clause bsdl", "bsdl"), ("php-3", r"this product includes php software freely available from", "php"), ("php-3", r"this source file is subject to version 3 0?1? of the php licen[sc]e", "php"), ("python-2", r"python software foundation licen[sc]e version 2", "python"), ("python-2", r"psf is making python available to licensee on an as is basis", "psf"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "agreement"), ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "alter"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software", "misrepresented"), ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "misrepresented"), ("libpng", r"this copy of the libpng notices is provided for your convenience", "libpng"), ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg"),
    ("openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit", "openssl"), ("ssleay", r"this product includes cryptographic software written by eric young", "cryptographic"), ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", "hereby"), ("bsl-1", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization"),
    ("bsl-1", r"distributed under the boost software licen[sc]e version 1 0", "boost"), ("busl-1.1", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "licensor"), ("elastic-2", r"you may not provide the software to third parties as a hosted or managed service", "hosted"),
    ("sspl-1", r"server side public licen[sc]e", "server"), ("commons-clause", r"the software is provided to you by the licensor under the licen[sc]e as defined below subject to the following condition", "licensor"), ("commons-clause", r"the grant of rights under the licen[sc]e will not include and the licen[sc]e does not grant to you the right to sell the software", "sell"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "compile"), ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", "jurisdictions"), ("unlicense", r"for more information please refer to https? unlicense org", "unlicense"), ("wtfpl", r"you just do what the fuck you want to", "fuck"),
    ("cc0-1", r"to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "waived"), ("cc0-1", r"the person who associated a work with this deed has dedicated the work to the public domain", "deed"), ("cc-by", r"this work is licensed under (?:the |a )?creative commons attribution [1-4] [05] (?:international|unported|generic)", "attribution"),
    ("cc-by-sa", r"this work is licensed under (?:the |a )?creative commons attribution share ?alike", "alike"), ("cc-by-nc", r"this work is licensed under (?:the |a )?creative commons attribution non ?commercial [1-4]", "attribution"), ("cc-by-nc-sa", r"this work is licensed under (?:the |a )?creative commons attribution non ?commercial share ?alike", "alike"), ("cc-by-nc-nd", r"this work is licensed under (?:the |a )?creative commons attribution non ?commercial no ?deriv(?:ative)?s", "attribution"),
    ("cc-by-nd", r"this work is licensed under (?:the |a )?creative commons attribution no ?deriv(?:ative)?s", "attribution"), ("cc-by", r"creativecommons org licen[sc]es by [1-4]", "creativecommons"), ("cc-by-sa", r"creativecommons org licen[sc]es by sa", "creativecommons"), ("cc-by-nc", r"creativecommons org licen[sc]es by nc [1-4]", "creativecommons"), ("cc-by-nc-sa", r"creativecommons org licen[sc]es by nc sa", "creativecommons"), ("cc0-1", r"creativecommons org publicdomain zero", "creativecommons"),
    ("ofl-1.1", r"this font software is licensed under the sil open font licen[sc]e version 1 1", "font"), ("ofl-1.1", r"the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", "typefaces"), ("odbl", r"this (?:database|data set) is (?:made )?available under the open database licen[sc]e", "database"),
    ("odc-by", r"made available under the open data commons attribution licen[sc]e", "commons"), ("pddl", r"made available under the public domain dedication and licen[sc]e", "dedication"), ("openmaptiles", r"openstreetmap contributors", "openstreetmap"), ("ogl-uk", r"contains public sector information licensed under the open government licen[sc]e", "government"), ("etalab-2", r"licence ouverte open licence", "ouverte"),
    ("public-domain", r"this (?:work|file|code|software|text|book|image) is (?:hereby )?in the public domain", "domain"), ("public-domain", r"no copyright is claimed in the united states under title 17", "claimed"), ("public-domain", r"the author hereby disclaims copyright to this source code", "disclaims"), ("public-domain", r"project gutenberg ebook is for the use of anyone anywhere", "gutenberg"), ("blessing", r"may you do good and not evil may you find forgiveness for yourself", "forgiveness"),
    ("json", r"the software shall be used for good not evil", "evil"), ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer", "beer"), ("ms-pl", r"microsoft public licen[sc]e ms pl", "microsoft"), ("ms-rl", r"microsoft reciprocal licen[sc]e", "reciprocal"), ("ncsa", r"university of illinois ncsa open source licen[sc]e", "ncsa"), ("llvm-exception", r"llvm exceptions? to the apache", "llvm"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "vim"), ("tcl", r"the authors hereby grant permission to use copy modify distribute and licen[sc]e this software and its documentation for any purpose", "grant"), ("ibm-pl", r"ibm public licen[sc]e version 1", "ibm"), ("sun-bcl", r"binary code licen[sc]e agreement", "binary"), ("jdom", r"this software consists of voluntary contributions made by many individuals on behalf of the jdom project", "jdom"),
    ("w3c", r"this work is distributed under the w3c software (?:notice and )?licen[sc]e", "w3c"), ("unicode", r"unicode inc licen[sc]e agreement data files and software", "unicode"), ("icu", r"provided that the above copyright notice s and this permission notice appear in all copies of the software", "appear"), ("xfree86", r"xfree86 project inc", "xfree86"), ("naist", r"use reproduction and distribution of this software is permitted any copy of this software", "reproduction"),
    ("llama", r"llama [234](?: [0-9])? community licen[sc]e agreement", "community"), ("openrail", r"(?:creativeml|bigscience) (?:open )?rail(?:\+\+)? ?m? licen[sc]e", "rail"), ("gemma", r"gemma is provided under and subject to the gemma terms of use", "gemma"),
    ("proprietary", r"this (?:software|document|file) (?:is|contains) (?:the )?(?:strictly )?confidential", "confidential"), ("proprietary", r"this (?:software|document|file) (?:is|contains) (?:the )?proprietary", "proprietary"), ("proprietary", r"(?:is a|contains) trade secrets? of", "secret"), ("proprietary", r"no part of this (?:publication|book|work|document) may be reproduced (?:stored )?", "reproduced"), ("proprietary", r"may not be (?:copied|reproduced|redistributed) without (?:the )?(?:prior |express |explicit )?(?:written )?permission", "permission"), ("proprietary", r"subject to the terms of (?:your|the) end user licen[sc]e agreement", "agreement"),
    ("proprietary", r"reproduction in whole or in part without (?:written )?permission is prohibited", "prohibited"), ("proprietary", r"todos los derechos reservados", "derechos"), ("proprietary", r"tous droits reserves|tous droits r\u00e9serv\u00e9s", "droits"), ("proprietary", r"alle rechte vorbehalten", "rechte"), ("non-commercial", r"not for commercial use", "commercial"), ("non-commercial", r"for academic(?: and research)? (?:use|purposes) only", "academic"), ("non-commercial", r"for educational(?: and research)? (?:use|purposes) only", "educational"),
)
@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    priority: int
    confidence: float
    needs: tuple[str, ...]


def rules() -> list[Rule]:
    """All signature rules, in order of priority."""
    out = []
    for label, name, word in FAMILIES:
        for frame, priority, confidence, needs in FRAMES:
            out.append(Rule(label, frame.format(name), priority, confidence, tuple(w for w in (word, needs, "" if "spdx" in frame or needs == "under" else "licen") if w)))
        if label in PLAIN:
            out.append(Rule(label, name, 40, 0.6, (word,) if word else ()))
    out += [Rule(label, text, 85, 0.97, (word,)) for label, text, word in SENTENCES]
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern))


_READY: list = []


def _ready():
    """Compiled rules, and the automaton of their keywords; once a process."""
    if not _READY:
        compiled = [(r, re.compile(rf"(?<= )(?:{r.pattern})(?= )")) for r in rules()]
        keys = ahocorasick.Automaton()
        for w in {w for r, _ in compiled for w in r.needs}:
            keys.add_word(w, w)
        # Rules without a keyword of their own start from the letters of their names.
        for w in _LOOSE:
            keys.add_word(w, w)
        keys.make_automaton()
        _READY.append((compiled, keys))
    return _READY[0]


#: A text that has none of these cannot match a rule that has no keyword.
_LOOSE = ("gpl", "public", "mit", "expat", "free documentation", "gfdl", "fdl", "mpl", "epl", "cddl", "development and", "eupl", "european", "wtfpl", "creative commons", "cc0", "cc by", "open d", "odbl", "odc", "open font", "ofl", "python software", "psf", "microsoft", "ms pl", "ms rl", "universal permissive", "upl", "server side", "sspl", "open", "mozilla", "eclipse")


def detect(joined: str) -> list[tuple[int, int, Rule]]:
    """Detections in a text's words, joined by and between single spaces, as character ranges; none within a stronger one."""
    compiled, keys = _ready()
    there = {w for _, w in keys.iter(joined)}
    loose = not there.isdisjoint(_LOOSE)
    found = []
    for rule, pattern in compiled:
        if (all(w in there for w in rule.needs)) if rule.needs and rule.needs != ("licen",) else (loose and all(w in there for w in rule.needs)):
            found += [(m.start(), m.end(), rule) for m in pattern.finditer(joined)]
    found.sort(key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label))
    # Largest end of the kept detections that start at or before a place, in a tree of prefix maxima over the distinct starts.
    at = {s: i + 1 for i, s in enumerate(sorted({s for s, _, _ in found}))}
    tree = [0] * (len(at) + 1)
    kept: list[tuple[int, int, Rule]] = []
    for s, e, rule in found:
        i, far = at[s], 0
        while i:
            far = max(far, tree[i])
            i &= i - 1
        if far < e:
            kept.append((s, e, rule))
            i = at[s]
            while i < len(tree):
                tree[i] = max(tree[i], e)
                i += i & -i
    return kept


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scan_text(text: str) -> tuple[int, int | None, int | None, str, str, float]:
    """n_base, first_word, last_word, base_labels, labels and score of a text with A-Z lower-cased."""
    joined = " " + " ".join(_WORD.findall(text)) + " "
    starts = [m.end() for m in re.finditer(" ", joined)]
    places, base = [], set()
    for phrase, label in BASE.items():
        needle, at = f" {phrase} ", joined.find(f" {phrase} ")
        while at >= 0:
            places.append(bisect.bisect_left(starts, at + 1))
            base.add(label)
            at = joined.find(needle, at + 1)
    found = detect(joined)
    miss = 1.0
    for _, _, rule in found:
        miss *= 1 - rule.confidence
    for _ in base:
        miss *= 0.05
    labels = base | {r.label for _, _, r in found}
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - miss, 6) if labels else 0.0


def count_words(texts: pa.Array) -> np.ndarray:
    """Words of each text: runs of 0-9, A-Z, a-z and characters beyond ASCII."""
    a = texts.cast(pa.large_binary())
    sizes = pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return np.zeros(len(ends), np.int64)
    start = int(np.frombuffer(a.buffers()[1], np.int64)[a.offset])
    data = np.frombuffer(a.buffers()[2], np.uint8)[start:start + int(ends[-1])]
    lut = np.zeros(256, bool)
    lut[48:58] = lut[65:91] = lut[97:123] = lut[128:] = True
    word = lut[data]
    fresh = word.copy()
    fresh[1:] &= ~word[:-1]
    begins = (ends - sizes)[sizes > 0]
    fresh[begins] = word[begins]
    total = np.concatenate([[0], np.cumsum(fresh)])
    return total[ends] - total[ends - sizes]


def _first() -> str:
    """A pattern that texts with a detection match: what a family's names cannot do without, whatever the frame."""
    names = {word for _, _, word in FAMILIES if word} | {w.split()[0] for w in _LOOSE} | {word for _, _, word in SENTENCES}
    names |= {"documentation"}
    names -= {"free", "common"}  # such names also have "documentation" or "licen"
    whole = {w for w in names if len(w) <= 4 and w not in ("gpl", "fdl", "open", "bsd")}
    # Any blank or mark parts words, the underscore too, so \b does not do.
    return "licen|spdx|" + "|".join(sorted(names - whole)) + "|(?:^|[^0-9a-z])(?:" + "|".join(sorted(whole)) + ")(?:[^0-9a-z]|$)"


#: Every rule and base phrase has one of these, so texts without any are done.
FIRST = re.compile(_first())


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        texts = pc.ascii_lower(b.column("text"))
        may = pc.match_substring_regex(texts, FIRST.pattern).to_numpy(zero_copy_only=False)
        n = count_words(texts)
        rows = [(0, None, None, "", "", 0.0)] * len(may)
        for i in np.flatnonzero(may):
            rows[i] = scan_text(texts[int(i)].as_py())
        cols = [*zip(*rows, strict=True)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    No shuffle. A null or empty text has no word and no label (empty strings, null words, score 0); repeated
    rows are scanned alike; an empty table gives an empty result; other columns are ignored. score is the
    chance that at least one detection is right, by the rules' confidences.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return base.mapInArrow(_scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
