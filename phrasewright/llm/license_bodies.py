"""Signatures of the clauses that licence texts are made of, written by hand, over normalised words.

Fixed values: wording of published licences. ``@`` marks the keyword that the prefilter looks for.
"""

from __future__ import annotations

#: label: patterns of clauses that name or make up this licence.
BODIES = {
    "mit": (
        "to deal in the software without @restriction including without limitation the rights to use copy modify merge publish distribute",
        "rights to use copy modify merge publish distribute @sublicense and or sell copies of the software",
        "and to @permit persons to whom the software is furnished to do so subject to the following conditions",
        "above copyright notice and this permission notice shall be included in all copies or @substantial portions of the software",
        "in no event shall the authors or copyright @holders be liable for any claim damages or other liability",
        "whether in an action of contract tort or otherwise @arising from out of or in connection with the software",
        "express or implied including but not limited to the @warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "x11": ("name of the x @consortium shall not be used in advertising or otherwise to promote", "portions of the software except as contained in this notice the name of the x @consortium"),
    "isc": (
        "permission to use copy modify and or distribute this software for any @purpose with or without fee is hereby granted",
        "provided that the above copyright notice and this permission notice appear in all @copies",
        "the author @disclaims all warranties with regard to this software including all implied warranties",
        "loss of use data or profits whether in an action of contract @negligence or other tortious action",
        "be liable for any special direct indirect or @consequential damages or any damages whatsoever resulting from",
    ),
    "bsd-0-clause": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby @granted the software",),
    "bsd": (
        "@redistributions in binary form must reproduce the above copyright notice this list of conditions",
        "with or without modification are permitted provided that the following conditions are @met",
        "this software is provided by the copyright holders and @contributors as is and any express or implied warranties",
        "this software is provided by the @regents and contributors as is",
        "in no event shall the copyright (?:holder|owner) or @contributors be liable for any direct indirect",
        "(?:procurement of )?@substitute goods or services loss of use data or profits or business interruption",
        "however caused and on any theory of liability whether in contract strict liability or @tort",
    ),
    "bsd-3-clause": (
        "may be used to @endorse or promote products derived from this software without specific prior written permission",
        "neither the name of the (?:copyright holder|university|author|organization) nor the names of its contributors may be used to @endorse",
    ),
    "bsd-4-clause": (
        "all @advertising materials mentioning features or use of this software must display the following",
        "must display the following @acknowledgement this product includes software developed by",
    ),
    "apache-1.1": ("the end user documentation included with the redistribution if any must include the following @acknowledgment", "products derived from this software may not be called apache nor may @apache appear in their name"),
    "apache-2.0": (
        "you may not use this file except in @compliance with the license",
        "@unless required by applicable law or agreed to in writing software distributed under the license",
        "distributed on an as is basis without warranties or @conditions of any kind either express or implied",
        "see the license for the specific language governing @permissions and limitations under the license",
        "each contributor hereby grants to you a @perpetual worldwide non exclusive no charge royalty free irrevocable",
        "copyright license to reproduce prepare derivative works of publicly display publicly perform @sublicense and distribute the work",
        "patent license to make have made use offer to sell sell import and otherwise @transfer the work",
        "if you institute patent @litigation against any entity including a cross claim or counterclaim",
        "you must cause any modified files to carry prominent @notices stating that you changed the files",
        "if the work includes a notice text file as part of its @distribution then any derivative works",
        "does not grant permission to use the trade names @trademarks service marks or product names of the licensor",
        "any contribution @intentionally submitted for inclusion in the work by you to the licensor",
        "you may add your own @attribution notices within derivative works that you distribute",
    ),
    "gpl": (
        "this program is distributed in the hope that it will be @useful but without any warranty",
        "without even the implied warranty of @merchantability or fitness for a particular purpose",
        "you should have received a copy of the gnu @general public license along with",
        "either version (?:1|2|3) of the license or at your option any later @version",
        "everyone is permitted to copy and distribute @verbatim copies of this license document but changing it is not allowed",
        "the licenses for most software are designed to take away your @freedom to share and change it",
        "to protect your rights we need to (?:make restrictions that forbid|prevent) (?:others|anyone) (?:from denying|to deny) you these @rights",
        "when we speak of free software we are @referring to freedom not price",
        "you must give the @recipients all the rights that you have",
        "you must show them these terms so they know their @rights",
        "write to the free software foundation inc (?:51|59|675) [a-z0-9 ]{1,60}@boston",
    ),
    "gpl-2": (
        "activities other than copying distribution and modification are not covered by this license they are outside its @scope",
        "you may copy and distribute verbatim copies of the program s source code as you receive it in any @medium",
        "you must cause the modified files to carry prominent notices stating that you changed the files and the @date of any change",
        "a work based on the program means either the program or any derivative work under @copyright law",
        "@accompany it with the complete corresponding machine readable source code",
        "you are not required to accept this license since you have not @signed it",
        "you may not impose any further @restrictions on the recipients exercise of the rights granted herein",
        "mere @aggregation of another work not based on the program with the program",
    ),
    "gpl-3": (
        "to propagate a work means to do anything with it that without permission would make you directly or @secondarily liable",
        "to convey a work means any kind of @propagation that enables other parties to make or receive copies",
        "@conveying verbatim copies you may convey verbatim copies of the program s source code",
        "no covered work shall be deemed part of an effective technological measure under any applicable law fulfilling @obligations",
        "you may convey a covered work in object code form under the terms of sections 4 and 5 @provided that you also convey",
        "installation information for a user product means any methods procedures @authorization keys",
        "an entity @transaction is a transaction transferring control of an organization",
        "you may not convey a covered work if you are a party to an @arrangement with a third party",
        "the @preferred form of the work for making modifications to it",
        "the gnu general public license is a free @copyleft license for software and other kinds of works",
    ),
    "lgpl": (
        "(?:this|the) library is free software you can @redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public",
        "this library is distributed in the hope that it will be @useful but without any warranty",
        "a program that contains no @derivative of any portion of the library but is designed to work with the library",
        "a work that uses the @library is a work",
        "the modified work must itself be a software @library",
        "use a suitable shared @library mechanism for linking with the library",
        "you may convey a combined work under terms of your choice that taken together effectively do not @restrict modification",
        "this version of the gnu @lesser general public license incorporates the terms and conditions",
    ),
    "agpl": (
        "an opportunity to receive the corresponding source of your version by providing access to the corresponding source from a @network server",
        "all users interacting with it @remotely through a computer network",
        "@remote network interaction use with the gnu general public license",
        "specifically designed to ensure cooperation with the community in the case of network @server software",
    ),
    "gfdl": (
        "permission is granted to copy distribute and or modify this document under the terms of the gnu free @documentation license",
        "with no @invariant sections no front cover texts and no back cover texts",
        "a @transparent copy of the document means a machine readable copy",
        "a secondary section is a named @appendix or a front matter section of the document",
    ),
    "mpl": (
        "this source code form is subject to the terms of the @mozilla public license",
        "if a copy of the mpl was not distributed with this file you can @obtain one at",
        "@covered software is provided under this license on an as is basis without warranty of any kind",
        "this source code form is @incompatible with secondary licenses as defined by the mozilla public license",
        "the contents of this file are subject to the mozilla public license @version",
        "the initial developer of the original @code is",
        "alternatively the contents of this file may be used under the terms of either the gnu @general public license",
        "each contributor hereby grants you a world wide royalty free non @exclusive license under intellectual property rights",
    ),
    "epl": (
        "the accompanying program is provided under the terms of this @eclipse public license",
        "this program and the accompanying materials are made @available under the terms of the eclipse public license",
        "any use reproduction or distribution of the program constitutes @recipient s acceptance of this agreement",
        "each contributor must identify itself as the @originator of its contribution",
        "a commercial contributor @agrees to defend and indemnify every other contributor",
    ),
    "cddl": (
        "the contents of this file are subject to the terms of the common development and distribution @license",
        "when distributing covered code include this @cddl header in each file",
        "you can @obtain a copy of the license at usr src opensolaris license",
    ),
    "eupl": (
        "licensed under the eupl version 1 [012] or as soon they will be approved by the european @commission",
        "subsequent versions of the @eupl",
        "you may not use this work except in compliance with the @licence",
    ),
    "artistic": (
        "the intent of this document is to state the conditions under which a package may be @copied",
        "the copyright holder maintains some semblance of @artistic control over the development of the package",
        "you may @otherwise modify your copy of this package in any way provided that you insert a prominent notice",
        "place your modifications in the public domain or otherwise make them @freely available such as by posting said modifications",
        "the scripts and library files supplied as input to or produced as output from the programs of this @package",
    ),
    "zlib": (
        "in no event will the authors be held @liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including @commercial applications",
        "the origin of this software must not be @misrepresented you must not claim that you wrote the original software",
        "altered source versions must be @plainly marked as such and must not be misrepresented",
        "this notice may not be removed or @altered from any source distribution",
        "an acknowledgment in the product documentation would be @appreciated but is not required",
    ),
    "libpng": ("the png reference library is supplied as is the contributing authors and group 42 inc @disclaim all warranties", "this code is released under the @libpng license"),
    "boost": (
        "permission is hereby granted free of charge to any person or @organization obtaining a copy of the software and accompanying documentation",
        "solely in the form of machine @executable object code generated by a source language processor",
        "distributed under the @boost software license version 1 0",
        "to use reproduce display distribute execute and @transmit the software and to prepare derivative works",
    ),
    "unlicense": (
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled @binary",
        "in jurisdictions that recognize copyright laws the author or authors of this software @dedicate any and all copyright interest",
        "we make this dedication for the benefit of the public at large and to the @detriment of our heirs and successors",
        "overt act of @relinquishment in perpetuity of all present and future rights to this software under copyright law",
    ),
    "wtfpl": ("modified copies of this license document and changing it is allowed as long as the name is @changed", "do what the @fuck you want to public license"),
    "cc0": (
        "has waived all copyright and related or neighboring rights to this work to the @extent possible under law",
        "the person who associated a work with this deed has @dedicated the work to the public domain",
        "affirmer hereby overtly fully permanently irrevocably and @unconditionally waives abandons and surrenders",
        "a statement of @purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright",
        "to the extent possible under law [a-z0-9 ]{1,60}has @waived all copyright",
    ),
    "cc-by": (
        "you are free to share copy and @redistribute the material in any medium or format",
        "you must give appropriate @credit provide a link to the license and indicate if changes were made",
        "you may do so in any reasonable manner but not in any way that suggests the licensor @endorses you or your use",
        "by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this @creative commons",
        "except where otherwise noted (?:content on this site|this work) is licensed under a @creative commons",
    ),
    "cc-by-sa": ("if you remix transform or build upon the material you must distribute your @contributions under the same license as the original", "adapter s license you apply must be a @creative commons license with the same license elements"),
    "cc-by-nc": ("you may not use the material for @commercial purposes", "primarily intended for or directed towards @commercial advantage or monetary compensation"),
    "cc-by-nd": ("if you remix transform or build upon the material you may not distribute the modified @material", "you do not have permission under this public license to share @adapted material"),
    "ofl": (
        "sold as part of a larger software package but no copy of one or more of the original or modified versions of the @font",
        "no modified version of the @font software may use the reserved font name",
        "this font software is licensed under the sil open @font license",
        "the goals of the open font license ofl are to stimulate worldwide development of collaborative @font projects",
        "neither the @font software nor any of its individual components in original or modified versions may be sold by itself",
    ),
    "odbl": ("this @database is made available under the open database license", "any rights in individual contents of the @database are licensed under the database contents license"),
    "pddl": ("the licensor dedicates the work to the public domain and permanently and irrevocably waives all rights in the @database",),
    "psf": ("psf is making python available to licensee on an as is @basis", "psf hereby grants licensee a nonexclusive royalty free world wide license to @reproduce analyze test perform"),
    "php": ("this product includes @php software freely available from", "products derived from this software may not be called php nor may @php appear in their name"),
    "openssl": ("this product includes software developed by the @openssl project for use in the openssl toolkit", "the names openssl toolkit and @openssl project must not be used to endorse", "this product includes @cryptographic software written by eric young"),
    "postgresql": ("in no event shall the university of california be liable to any party for direct indirect special incidental or @consequential damages", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written @agreement"),
    "ncsa": ("to deal with the software without @restriction including without limitation the rights to use copy modify merge", "redistributions of source code must retain the above copyright notice this list of conditions and the following @disclaimers"),
    "json": ("the software shall be used for good not @evil",),
    "beerware": ("if we meet some day and you think this stuff is worth it you can buy me a @beer in return", "as long as you @retain this notice you can do whatever you want with this stuff"),
    "ms-pl": ("if you use the software you accept this license if you do not accept the license do not use the @software", "each contributor grants you a non exclusive worldwide royalty free copyright license to @reproduce its contribution"),
    "upl": ("and any and all patent rights owned or freely licensable by each @licensor hereunder covering either",),
    "sspl": ("if you make the functionality of the program or a modified version available to third parties as a @service",),
    "bsl": ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non @production use of the licensed work", "effective on the @change date or the fourth anniversary of the first publicly available distribution"),
    "elastic": ("you may not provide the software to third parties as a @hosted or managed service", "you may not move change disable or @circumvent the license key functionality in the software"),
    "commons-clause": ("the software is provided to you by the licensor under the license as defined below subject to the following @condition", "the license does not include and the license does not @grant to you the right to sell the software"),
    "lppl": ("this work may be distributed and or modified under the conditions of the @latex project public license", "this work has the lppl @maintenance status"),
    "cecill": ("this software is governed by the @cecill license under french law and abiding by the rules of distribution of free software", "as a counterpart to the access to the source code and rights to copy modify and @redistribute granted by the license"),
    "public-domain": (
        "this (?:work|software|file|program|code) is in the public @domain", "placed (?:in|into) the public @domain", "no @copyright is claimed", "not subject to @copyright protection",
        "this is a work of the (?:us|u s|united states) @government", "the author @disclaims copyright to this source code", "in place of a legal notice here is a @blessing",
    ),
    "no-warranty": (
        "there is no @warranty for the (?:program|library|software)", "the entire @risk as to the quality and performance of the (?:program|software) is with you", "use at your own @risk",
        "without @warranties or conditions of any kind", "any express or implied @warranties", "in no event (?:shall|will) [a-z0-9 ]{1,60}be @liable", "@disclaimer of warranty", "@limitation of liability",
        "(?:ohne|keine) (?:jede )?@gewährleistung", "sans @garantie", "sin @garantía",
    ),
    "reserved": (
        "@tous droits réservés", "todos los derechos @reservados", "all @rights are reserved", "(?:nachdruck|vervielfältigung) nur mit @genehmigung", "reproduction @interdite", "queda @prohibida la reproducción",
    ),
    "proprietary": (
        "this software is the @confidential and proprietary information of", "you shall not disclose such @confidential information", "no part of this (?:publication|document|book|work) may be @reproduced",
        "stored in a @retrieval system or transmitted in any form or by any means", "(?:for|strictly for) @internal use only", "contains trade @secrets", "@reverse engineer decompile or disassemble",
        "is licensed not @sold", "nontransferable(?: and)? nonexclusive @license", "without the (?:express )?(?:prior )?@written (?:permission|consent) of the (?:publisher|author|owner|copyright holder)",
    ),
    "attribution": ("must @acknowledge the source", "@reprinted with permission", "reproduced with (?:kind )?@permission", "used (?:by|with) @permission", "@courtesy of the (?:author|publisher|artist|photographer)"),
    "license-notice": (
        "for the full @license text see", "see (?:the )?@copying for", "(?:subject to|governed by) the terms of this @agreement", "by (?:downloading|installing|using) (?:this|the) software you @agree", "dual @licensed under",
        "distributed under the same @terms as", "@licensed to you under", "the @licensor grants", "this @licence applies to", "unter der @lizenz", "sous @licence", "bajo la @licencia",
    ),
}

#: Labels of clauses that many licences share: priority and score. Those of one licence have BODY.
SHARED = {"no-warranty": (30, 0.6), "reserved": (30, 0.6), "proprietary": (40, 0.7), "attribution": (20, 0.4), "license-notice": (10, 0.4), "public-domain": (50, 0.8)}
BODY = (65, 0.9)
