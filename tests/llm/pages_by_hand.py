"""Pages written by hand, none made by the operator's generator.  A block that begins with
a pilcrow is main text; the mark is taken out before the page is read."""

P1 = "¶The old ferry will stop running in October, the port office said, after more than ninety years of service between the two banks of the river."
P2 = "¶Passengers who hold a yearly pass can ask for a refund at any ticket office. Others may use the new bridge, which opens for walkers next week."
P3 = "¶“It was never about the money,” said the captain, who has steered the boat since he was nineteen. “People met on it, and some of them got married.”"
P4 = "¶Engineers measured the hull last month and found that large parts of the steel had grown too thin to be repaired at a sensible cost."
P5 = "¶A museum in the old town wants to take the vessel, but it would first have to dig a basin that is deep enough."
P6 = "¶Heat the oil in a wide pan, add the onions and cook them slowly until they are soft and just begin to colour, which takes about ten minutes."
P7 = "¶Stir in the rice, pour over half of the stock and wait until it has been taken up before you add the rest, a ladle at a time."
P8 = "¶Der Gemeinderat hat am Montag beschlossen, die alte Schule zu sanieren und nicht, wie geplant, durch einen Neubau zu ersetzen."
P9 = "¶Die Arbeiten sollen im Frühjahr beginnen. Bis dahin lernen die Kinder in den Räumen des Vereinsheims, das dafür umgebaut wurde."
P10 = "¶To install the tool, download the archive, unpack it into a folder of your choice and add that folder to the search path of your shell."
P11 = "¶The second argument names the table; if it is left out, the last one that was opened is used, and an error is raised if there was none."
P12 = "¶We walked along the ridge for three hours without meeting anyone, and the clouds stayed below us like a sea without a shore."

PAGES = {
    "news with made class names": f"<html><body><div class='css-1k2j3'><div class='css-aa0b1'><a href='/'>Start</a><a href='/w'>World</a><a href='/s'>Sport</a></div><div class='css-9f8e7'><h1 class='css-t1'>¶River ferry to stop after ninety years</h1><p class='css-p0'>{P1}</p><p class='css-p0'>{P2}</p><p class='css-p0'>{P3}</p></div><div class='css-q7w8'><h4>More on this</h4><a href='/1'>Bridge to open early</a><a href='/2'>Ten boats that made history</a></div><div class='css-l0l0'>© 2023 River Post. All rights reserved.</div></div></body></html>",
    "no classes at all": f"<body><div><a href=/>Home</a> | <a href=/about>About</a> | <a href=/mail>Contact</a></div><h1>¶River ferry to stop</h1><p>{P1}<p>{P2}<p>{P4}<hr><p>Copyright 2021 by the port office</body>",
    "byline and share row": f"<body><main><h1>¶River ferry to stop</h1><div>By Ann Writer</div><div><a href=#>Share</a> <a href=#>Tweet</a> <a href=#>Email</a></div><p>{P1}</p><p>{P3}</p><p>{P5}</p></main><footer><p>Imprint and terms</p></footer></body>",
    "article between header and aside": f"<body><header><div>The River Post</div><nav><a href=/a>News</a><a href=/b>Views</a></nav></header><article><h1>¶River ferry to stop</h1><p>{P1}</p><h2>¶What comes next</h2><p>{P2}</p><p>{P4}</p></article><aside><h3>Most read</h3><ul><li><a href=/x>A whale in the harbour</a></li><li><a href=/y>Why gulls steal chips</a></li></ul></aside><footer>© River Post</footer></body>",
    "comments without class": f"<body><article><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P2}</p><p>{P5}</p></article><section><h3>12 Comments</h3><ol><li><b>jo77 says:</b><p>I took it every day to school and will miss it a lot.</p><a href=#>Reply</a></li><li><b>Marge said</b><p>About time, it was always late in winter.</p><a href=#>Reply</a></li></ol></section></body>",
    "cookie bar first": f"<body><div class='x1'><p>We use cookies to give you the best experience. By clicking accept you consent to our privacy policy.</p><button>Accept all</button></div><div class='x2'><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P4}</p><p>{P3}</p></div></body>",
    "newsletter box inside": f"<body><article><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P2}</p><div><h4>Subscribe to our newsletter</h4><p>Sign up and get the news in your inbox.</p><form><input type=email><button>Sign up</button></form></div><p>{P4}</p><p>{P5}</p></article></body>",
    "table layout": f"<body><table width=100%><tr><td colspan=2><a href=/>Home</a> <a href=/l>Links</a> <a href=/g>Guestbook</a></td></tr><tr><td width=150><ul><li><a href=/1>Ferries</a></li><li><a href=/2>Bridges</a></li><li><a href=/3>Tolls</a></li></ul></td><td><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P4}</p><p>{P2}</p></td></tr><tr><td colspan=2>Copyright 1999 J. Miller</td></tr></table></body>",
    "recipe": f"<body><nav><ul><li><a href=/>Recipes</a></li><li><a href=/m>Menus</a></li></ul></nav><main><h1>¶Slow rice with onions</h1><ul><li>¶two large onions, sliced</li><li>¶a cup of short rice</li><li>¶a litre of hot stock</li></ul><p>{P6}</p><p>{P7}</p></main><footer>© Kitchen notes</footer></body>",
    "german news": f"<body><div id=top><a href=/>Startseite</a><a href=/p>Politik</a><a href=/s>Sport</a></div><div><h1>¶Alte Schule wird saniert</h1><p>{P8}</p><p>{P9}</p></div><div>Anzeige <a href=/w>Jetzt günstig Strom wechseln</a></div><div><a href=/i>Impressum</a> <a href=/d>Datenschutz</a></div></body>",
    "documentation": f"<body><nav class=k1><a href=/a>Guide</a><a href=/b>Reference</a><a href=/c>Download</a></nav><main><h1>¶Getting started</h1><p>{P10}</p><pre>¶tool open table.db --read-only</pre><p>{P11}</p><h2>¶Options</h2><dl><dt>¶--read-only</dt><dd>¶Open the table without the right to write to it.</dd></dl></main></body>",
    "blog in nested divs": f"<body><div><div><div><a href=/>About me</a> <a href=/arch>Archive</a></div><div><div><h1>¶Three hours on the ridge</h1><div><p>{P12}</p><p>{P5}</p><p>{P3}</p></div></div></div><div><p>Older: <a href=/o>A night in the hut</a></p></div></div></div></body>",
    "section wrapper": f"<body><header><h2>Hill Walker</h2></header><section><h1>¶Three hours on the ridge</h1><p>{P12}</p><blockquote>¶The hills do not care who comes, my father used to say, and he was right.</blockquote><p>{P2}</p></section><section><h3>Related posts</h3><ul><li><a href=/1>Boots that last</a></li><li><a href=/2>Maps and how to fold them</a></li></ul></section></body>",
    "login and search forms": f"<body><form action=/s><input name=q><button>Search</button></form><form><label>User</label><input><label>Password</label><input><button>Log in</button></form><div><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P4}</p></div></body>",
    "hidden popup": f"<body><div style='display:none'><p>Wait! Before you go, take a look at our offers of the week.</p></div><article><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P2}</p></article></body>",
    "figure and caption": f"<body><nav><a href=/>Home</a><a href=/n>News</a></nav><article><h1>¶River ferry to stop</h1><figure><img src=a.jpg><figcaption>¶The ferry on its last but one trip</figcaption></figure><p>{P1}</p><p>{P3}</p></article></body>",
    "advert between paragraphs": f"<body><main><h1>¶River ferry to stop</h1><p>{P1}</p><div>Advertisement<p><a href=/buy>Cheap flights to the islands</a></p></div><p>{P2}</p><p>{P4}</p></main></body>",
    "telling classes": f"<body><div class=navbar><a href=/>Home</a></div><div class=content><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P5}</p></div><div class=sidebar><h3>Tides</h3><p>High water is at nine in the evening today.</p></div><div class=footer>Port office, quay 3</div></body>",
    "unclosed paragraphs and odd ends": f"<body><div><a href=/>Home</a></b></div><h1>¶River ferry to stop</h1><p>{P1}</i><p>{P2}</span></div><p>{P4}</body>",
    "scripts in between": f"<body><script src=https://cdn.example/></script><article><h1>¶River ferry to stop</h1><p>{P1}</p><script>document.write('<p>not this</p>');</script><p>{P2}</p><style>p {{ margin: 0 }}</style><p>{P3}</p></article></body>",
    "short article": f"<body><nav><a href=/>Home</a><a href=/a>All news</a></nav><article><h1>¶Ferry late</h1><p>{P2}</p></article><footer>© Port office</footer></body>",
    "long menu, short text": "<body><nav>" + "".join(f"<a href=/{k}>Place {k}</a>" for k in range(40)) + f"</nav><main><h1>¶Ferry late</h1><p>{P1}</p><p>{P4}</p></main></body>",
    "links inside the text": f"<body><div><a href=/>Home</a><a href=/n>News</a></div><div><h1>¶River ferry to stop</h1><p>¶The old ferry will <a href=/x>stop running</a> in October, the <a href=/p>port office</a> said on Monday, after more than ninety years.</p><p>{P2}</p><p>{P4}</p></div></body>",
    "breadcrumbs and date": f"<body><div><a href=/>Home</a> &gt; <a href=/n>News</a> &gt; Ferry</div><h1>¶River ferry to stop</h1><div>Published March 3, 2021</div><div><p>{P1}</p><p>{P2}</p><p>{P5}</p></div></body>",
    "teaser list below": f"<body><article><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P3}</p></article><div><h2>You might also like</h2><div><h3><a href=/1>A whale in the harbour</a></h3><p>It came with the tide and left with it.</p></div><div><h3><a href=/2>Gulls and chips</a></h3><p>They watch your eyes before they dive.</p></div></div></body>",
    "article with header inside": f"<body><article><header><h2>River Post</h2><p>Since 1902</p></header><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P2}</p><footer><p>Tags: <a href=/t>ferry</a> <a href=/u>river</a></p></footer></article></body>",
    "breaks instead of paragraphs": f"<body><div><a href=/>Home</a> <a href=/m>Mail</a></div><div><h1>¶River ferry to stop</h1>{P1}<br><br>{P2}<br><br>{P4}</div><div>© 2001</div></body>",
    "data table in the text": f"<body><main><h1>¶Fares of the ferry</h1><p>{P2}</p><table><tr><th>¶Ticket</th><th>¶Price</th></tr><tr><td>¶Single</td><td>¶2.50</td></tr><tr><td>¶Return</td><td>¶4.00</td></tr></table><p>{P4}</p></main><footer>© Port office</footer></body>",
    "dialog and notice": f"<body><dialog open><p>Our shop has moved to a new street.</p></dialog><div role=alert>Service is limited on Sunday.</div><article><h1>¶River ferry to stop</h1><p>{P1}</p><p>{P2}</p></article></body>",
    "french": "<body><nav><a href=/>Accueil</a><a href=/c>Culture</a></nav><div><h1>¶Le vieux bac s’arrête</h1><p>¶Après quatre-vingt-dix ans de service, le bac qui relie les deux rives du fleuve cessera ses traversées au mois d’octobre.</p><p>¶Les abonnés pourront se faire rembourser aux guichets; les autres prendront le nouveau pont, ouvert aux piétons dès la semaine prochaine.</p></div><div>© 2022 La Rive. Mentions légales</div></body>",
    "no title": f"<body><div><a href=/>Home</a><a href=/b>Back</a></div><div><p>{P12}</p><p>{P3}</p><p>{P5}</p></div><div>© hill walker</div></body>",
    "list article": f"<body><nav><a href=/>Home</a><a href=/t>Tips</a></nav><article><h1>¶Five things to pack</h1><p>{P12}</p><ol><li>¶A map that you can read without a battery.</li><li>¶Socks, and one pair more than you think.</li><li>¶A whistle, for fog.</li></ol><p>{P5}</p></article></body>",
}
