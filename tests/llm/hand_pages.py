"""Pages written out by hand, none of them by the generator that the model learns from. Elements with the
attribute ``main`` hold the main text; the tests take it away before the page is read."""

PAGES = [
# articles about what elsewhere is furniture
"""<html><body><nav><a href="/">Home</a> <a href="/n">News</a></nav><div><h2 main>Comments on the budget</h2><p main>The minister read out forty pages in an hour and took no questions.</p><p main>Members of both houses had until Friday to answer in writing.</p><p main>A vote is planned for the second week of May.</p></div><footer>Copyright 2021, all rights reserved.</footer></body></html>""",
"""<html><body><header><a href="/">The Valley Post</a></header><article><h1 main>What readers say about the harbour</h1><p main>We asked two hundred people on the quay what they would change.</p><p main>Most of them wanted benches, and a third asked for longer ferry hours.</p><ul><li main>More benches along the wall</li><li main>A later last ferry</li><li main>Lights at the north steps</li></ul><p main>The harbour office will answer in June.</p></article><footer>The Valley Post</footer></body></html>""",
"""<body><ul id="menu"><li><a href="/1">Start</a></li><li><a href="/2">Shop</a></li></ul><div class="k7"><h1 main>How cookies keep their crunch</h1><p main>Cookies go soft because sugar draws water from the air.</p><p main>Keep them in a tin with a slice of dry bread, which takes up the water first.</p><h2 main>What not to do</h2><p main>Do not keep soft and hard cookies in one tin.</p></div><div class="cookie-banner">We use cookies. <button>Accept</button></div></body>""",
"""<html><body><div class="top"><a href="/">Search</a> <a href="/h">Help</a></div><main><h1 main>The search for the lost ship</h1><p main>Three boats have combed the bay since Monday without a trace of the Marigold.</p><p main>Search parties walked the shore at low tide and found two oars.</p><p main>The coast guard will go on until the weather turns.</p></main></body></html>""",
"""<html><body><nav><ul><li><a href="/a">Football</a></li><li><a href="/b">Tennis</a></li></ul></nav><article><h1 main>Sport in the village school</h1><p main>Every class now has an hour of sport a day, paid for by the club.</p><p main>Teachers say that afternoons are calmer since then.</p></article><aside><h3>Most read</h3><ul><li><a href="/1">Cup draw</a></li><li><a href="/2">New coach</a></li></ul></aside></body></html>""",
"""<html><body><nav><a href="/">Index</a></nav><article><h1 main>Why we share recipes</h1><p main>A recipe that is not shared is lost with the cook.</p><p main>Our grandmothers wrote theirs on the backs of letters, and we still cook from them.</p><blockquote main>Share the recipe and you share the table, she used to say.</blockquote></article><div class="share"><a href="s">Share</a> <a href="t">Tweet</a></div></body></html>""",
"""<html><body><div><a href="/">Home</a></div><div><h1 main>Privacy in small towns</h1><p main>Everybody knows everybody, and nobody reads the terms of anything.</p><p main>When the library put up cameras last year, eleven people complained, all of them by name.</p><p main>The cameras came down again in spring.</p></div><p><small>Contact | Privacy</small></p></body></html>""",
"""<html><body><nav><a href="/x">Archive</a></nav><article><h1 main>Three comments on tax</h1><p main>The first is that nobody likes it.</p><p main>The second is that roads do not grow by themselves, and the third is that the forms could be shorter.</p></article><section id="comments"><h3>2 comments</h3><p>Ben: Well put, all three of them.</p><p>Ida: The forms, please!</p></section></body></html>""",
"""<html><body><header><nav><a href="/">Home</a> <a href="/about">About</a></nav></header><main><h1 main>Subscribe to winter</h1><p main>There is a kind of cold that one has to sign up for months ahead.</p><p main>The hut on the ridge takes twelve guests and no telephone.</p></main><form class="newsletter"><label>Subscribe to our newsletter</label><input><button>Go</button></form></body></html>""",
"""<html><body><nav><a href="/">Front page</a></nav><article><h1 main>Advertisement and truth</h1><p main>In 1911 a soap maker promised whiter hands within a week.</p><p main>The court asked forty women to wash with it and looked at their hands.</p><p main>They were clean, the judge wrote, and no whiter.</p></article><div class="ad">Soap at half price this week only!</div></body></html>""",
# lists of links
"""<html><body><nav><a href="/">Home</a> <a href="/n">News</a></nav><main><h1 main>Ten walks for a short day</h1><ul><li><a main href="a">The river path</a></li><li><a main href="b">Old mill road</a></li><li><a main href="c">Castle hill and back</a></li></ul><p main>All of them can be done in an hour.</p></main><footer>Imprint</footer></body></html>""",
"""<html><body><div class="menu"><a href="/">Start</a></div><article><h1 main>Books we read this month</h1><p main>Four of us read eleven books, and these are the ones we would lend.</p><ul><li><a main href="1">The glass orchard</a></li><li><a main href="2">A winter on the line</a></li><li><a main href="3">Salt</a></li><li><a main href="4">The keeper of small boats</a></li></ul></article><div class="footer">Powered by the reading room</div></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><main><h1 main>Where to hear the choir</h1><p main>The choir sings in four churches before Christmas.</p><ol><li><a main href="1">Saint Anne, first Sunday</a></li><li><a main href="2">The old chapel, second Sunday</a></li><li><a main href="3">Market church, third Sunday</a></li></ol><p main>Doors open at five.</p></main></body></html>""",
"""<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/g">Garden</a></li></ul></nav><article><h1 main>Seeds by month</h1><h2 main>March</h2><ul><li><a main href="k">Kale</a></li><li><a main href="l">Leeks</a></li></ul><h2 main>April</h2><ul><li><a main href="b">Beans</a></li><li><a main href="p">Peas</a></li></ul><p main>Sow a week later above four hundred metres.</p></article></body></html>""",
# plain articles in many layouts
"""<html><body><table><tr><td><a href="1">One</a></td><td><a href="2">Two</a></td></tr></table><h1 main>The ferry is back</h1><p main>After a year in the yard the old ferry took her first cars across on Saturday.</p><p main>She has a new engine and the same bell.</p><p><small>Contact | Terms of use</small></p></body></html>""",
"""<html><body><div id="wrap"><div id="nav"><a href="/">Home</a> <a href="/w">Weather</a></div><div id="text"><h1 main>Rain at last</h1><p main>It began at four in the morning and did not stop for two days.</p><p main>Wells that had been dry since June stood at a metre again.</p></div><div id="footer">All rights reserved.</div></div></body></html>""",
"""<html><body><header class="masthead"><a href="/">Daily Current</a></header><section><h1 main>A bridge of rope</h1><p main>The village had voted against the bridge twice.</p><p main>Then the school bus had to go round by the pass for a whole winter, forty kilometres each way.</p><p main>The third vote took four minutes.</p></section><footer>&copy; Daily Current</footer></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>Counting birds</h1><p main>On the first Sunday of the year people sit at their windows and count.</p><div class="ad"><p>Binoculars at half price, order now.</p></div><p main>Last year nine thousand windows took part.</p><p main>The sparrow led, as always, but the finch is catching up.</p></article></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>The clockmaker</h1><p main>She works in a room without a clock.</p><p main>Asked why, she laughs: one would only look at it.</p><figure><img src="x.jpg"><figcaption main>The workshop in Mill Lane, seen from the street.</figcaption></figure><p main>Her oldest piece was made before the railway came.</p></article></body></html>""",
"""<html><body><div class="breadcrumb"><a href="/">Home</a> <a href="/r">Recipes</a></div><div class="recipe"><h1 main>Barley soup</h1><p main>Wash the barley and let it stand overnight.</p><ul><li main>200 g barley</li><li main>two onions</li><li main>one litre of stock</li></ul><p main>Fry the onions slowly, add the rest and cook for an hour.</p></div><div class="related"><h3>Related</h3><ul><li><a href="/1">Lentil soup</a></li><li><a href="/2">Leek soup</a></li></ul></div></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>Results of the survey</h1><p main>Of all households 61 per cent heat with wood, 22 with gas and the rest with both.</p><table><tr><td main>Wood</td><td main>61</td></tr><tr><td main>Gas</td><td main>22</td></tr></table><p main>The next survey is due in four years.</p></article></body></html>""",
"""<html><body><nav><a href="/">Home</a> <a href="/s">Sport</a></nav><main><h1 main>Late goal settles the derby</h1><p main>A header in the ninetieth minute gave the visitors all three points.</p><p main>The home side had led until the break.</p><p main>Both teams meet again in March.</p></main><div class="social"><a href="f">Follow us</a></div></body></html>""",
"""<html><body><div class="x1"><a href="/">Start</a></div><div class="x2"><h1 main>Moving the library</h1><p main>Eleven thousand books went down the stairs by hand, in a chain of two hundred people.</p><p main>It took from nine to five, with an hour for soup.</p><p main>Not one book was lost, though a cat was found.</p></div><div class="x3">Imprint | Privacy | Terms</div></body></html>""",
"""<html><body><header><a href="/">Notes</a></header><article><h1 main>On walking to work</h1><p main>I began because the bus was late, and went on because it kept being late.</p><p main>By spring I knew every gate.</p><p main>By autumn the gates knew me.</p><p main>I do not take the bus any more.</p></article><section class="comments"><h3>Reader comments</h3><p><b>Lena</b> 2 hours ago</p><p>So true, I do the same.</p></section></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h2 main>Harbour wall plan</h2><p main>The committee met four times in the spring and agreed on a plan for the wall.</p><p main>Work begins in June.</p><p main>The eastern part stays open to small boats throughout.</p></article><footer>Terms of use</footer></body></html>""",
"""<html><body><div role="navigation"><a href="/">Home</a></div><div role="main"><h1 main>Snow on the line</h1><p main>Trains between the two valleys stood still for six hours on Tuesday.</p><p main>Passengers were given tea by people who live beside the track.</p></div><div role="contentinfo">Copyright 2020</div></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>The last lamplighter</h1><p main>He lit four hundred lamps a night for thirty-one years.</p><p main>When the current came he was given a watch and a pension.</p><p main>He still goes round at dusk, his neighbours say, to see that all of them are on.</p></article><aside class="sidebar"><p>Advertisement</p><p>Lamps for every room, order now and save.</p></aside></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>Questions about the new road</h1><p main>Who pays for it?</p><p main>Half comes from the county and half from the toll.</p><p main>When will it open?</p><p main>In two years, if the winter is mild.</p></article><form action="/q"><label>Search this site</label><input><button>Go</button></form></body></html>""",
"""<html><body><div class="navbar"><a href="/">Home</a> <a href="/b">Blog</a></div><div class="post"><h1 main>Mending a chair</h1><p main>Take out the old cane with a blunt knife.</p><p main>Soak the new cane for twenty minutes, no longer.</p><p main>Weave from the middle outwards and keep it wet.</p><p main>Leave the chair alone for a day.</p></div><div class="comments"><h4>Leave a reply</h4><form><textarea></textarea></form></div></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>Letters from the front office</h1><p main>Dear members, the pool will be closed in August for repairs.</p><p main>We know that this is the warmest month, and we are sorry.</p><p main>Yours, the board</p></article><footer><a href="/p">Privacy</a></footer></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><section class="story"><h1 main>Read more slowly</h1><p main>A reader of the year 1800 owned six books and knew them by heart.</p><p main>A reader of today owns six hundred and knows their covers.</p><p main>Slow reading is no virtue, but it is a pleasure.</p></section><div class="more"><h3>You may also like</h3><ul><li><a href="/1">Why we skim</a></li><li><a href="/2">The first page</a></li></ul></div></body></html>""",
"""<html><body><div class="site-header"><a href="/">Field notes</a></div><div class="q4"><h1 main>The most read book of the year</h1><p main>It is a guide to mushrooms, borrowed nine hundred times from one library alone.</p><p main>The librarian thinks that most borrowers only look at the pictures.</p></div><div class="site-footer">Field notes, all rights reserved.</div></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>You may also like winter</h1><p main>People who hate winter have mostly never had one.</p><p main>Buy good boots first.</p><p main>Then go out every day, even if only to the corner.</p></article></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><div><h2 main>More stories from the valley</h2><p main>Old Peter told this one at the mill.</p><p main>A man came over the pass with a clock on his back and asked for the way to the sea.</p><p main>They sent him down the river, and the clock was never on time again.</p></div><footer>Copyright 2019</footer></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>Reader of the year</h1><p main>Maria is nine and has read every book on the two lower shelves.</p><p main>For the upper ones she has asked for a ladder.</p></article><div class="newsletter"><p>Sign up for free</p></div></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><div><h2 main>Leave a reply to the king</h2><p main>In the old hall hangs a letter that was never answered.</p><p main>The king had asked for the price of the island, and nobody dared to name one.</p><p main>Visitors may write an answer in the book below it.</p></div></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><div class="c9"><h1 main>Archive of the lost comments</h1><p main>A student has saved two million remarks from a forum that was shut down overnight.</p><p main>She reads a hundred a day.</p><p main>Most of them, she says, are kinder than one would think.</p></div></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>Discussion of the harbour wall</h1><p main>The wall was the only item, and the discussion lasted until midnight.</p><p main>Fishermen want it lower and bathers want it gone.</p><p main>The council wants it paid for.</p></article><footer>Imprint</footer></body></html>""",
"""<html><body><div class="cookie-notice">This site uses cookies. <button>Accept</button></div><nav><a href="/">Home</a></nav><article><h1 main>Help for tired soil</h1><p main>Clover gives back what wheat has taken.</p><p main>Sow it in August between the rows and dig it in when it flowers.</p><p main>After two years the worms return.</p></article></body></html>""",
"""<html><body><nav><a href="/">Home</a> <a href="/l">Login</a></nav><article><h1 main>Start again</h1><p main>The mill burned down on a Friday.</p><p main>On Monday forty people stood in the yard with hammers, and nobody had called them.</p><p main>It ground its first flour in May.</p></article><div class="share-buttons"><a href="c">Copy link</a> <a href="p">Print</a></div></body></html>""",
"""<html><body><header><a href="/">Town hall</a><nav><a href="/c">Contact</a> <a href="/o">Opening hours</a></nav></header><main><h1 main>New opening hours</h1><p main>From April the town hall opens at eight and closes at four.</p><p main>On Thursdays it stays open until seven.</p><p main>Passports can be fetched without an appointment.</p></main><footer>Town hall, Market Square 1</footer></body></html>""",
"""<html><body><nav><a href="/">Home</a></nav><article><h1 main>A short history of the footnote</h1><p main>Footnotes began as notes in the margin, where there was more room.</p><p main>Printers moved them down because margins cost paper.</p><p main>Scholars have filled the foot of the page ever since<a main href="#1">1</a>.</p></article><aside><p>Sponsored: shoes at half price this week only, order now.</p></aside></body></html>""",
]
