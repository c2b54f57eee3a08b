"""Pages laid out by hand in the manner of common publishing tools, with their main texts; nothing of them comes from the training grammar."""

PAGES = [
    (
        """<html><head><title>Tidal mills</title><style>.a{}</style></head><body class="home single"><div id="wrapper">
<div id="header" role="banner"><div class="site-title"><a href="/">Mill Notes</a></div><p class="site-description">Water, wood and stone</p>
<div class="menu-primary menu"><ul><li><a href="/a">Archive</a></li><li><a href="/b">Maps</a></li><li><a href="/c">Contact</a></li></ul></div></div>
<div id="content"><div class="post-412 post hentry"><h2 class="entry-title">How the tidal mill kept its hours</h2>
<div class="entry-content"><p>A mill on the coast has no river to lean on. It stores the flood behind a gate, and lets it out when the sea has gone.</p>
<p>The miller therefore worked by the moon, not by the clock: twice a day, an hour later each day, in the dark as often as not.</p>
<h3>The gate</h3><p>Made of elm, hung from the top, it closed by itself when the tide turned. <em>No hand touched it.</em></p>
<blockquote>We slept when the water let us.</blockquote><p>Few are left; the one at the river's mouth was mended in 1981 and still grinds.</p></div>
<div class="sharedaddy share"><a href="#">Tweet</a> <a href="#">Mail</a></div></div>
<div id="comments" class="comments-area"><h3>2 comments</h3><ol class="commentlist"><li class="comment"><p>My grandfather worked there until the war.</p></li>
<li class="comment"><p>Where can one see the gate today? I would love to visit it.</p></li></ol><div id="respond"><form><label>Your comment</label><textarea></textarea><button>Send</button></form></div></div></div>
<div id="sidebar" class="widget-area"><div class="widget"><h3>Recent posts</h3><ul><li><a href="/1">Windmills of the fen</a></li><li><a href="/2">Stones</a></li></ul></div></div>
<div id="footer"><p>&copy; 2019 Mill Notes. All rights reserved.</p></div></div></body></html>""",
        ["How the tidal mill kept its hours", "A mill on the coast has no river to lean on. It stores the flood behind a gate, and lets it out when the sea has gone.",
         "The miller therefore worked by the moon, not by the clock: twice a day, an hour later each day, in the dark as often as not.", "The gate",
         "Made of elm, hung from the top, it closed by itself when the tide turned. No hand touched it.", "We slept when the water let us.", "Few are left; the one at the river's mouth was mended in 1981 and still grinds."],
    ),
    (
        """<!doctype html><html lang=en><body><header class=page-header><nav aria-label=main><a href=/>News</a><a href=/sport>Sport</a><a href=/culture>Culture</a></nav></header>
<div class="cookie-banner" role=dialog><p>We use cookies to make this site better. By going on you accept them.</p><button>Accept</button></div>
<main><article><header><h1>Council votes to reopen the old ferry</h1></header>
<p>The ferry between the two banks, closed since the bridge was built, will run again from spring. The council voted nine to four on Monday night.<p>Supporters spoke of the hour that a walk over the bridge takes. Others feared for the birds that nest on the landing.
<aside class="ad"><p>Advertisement: shoes that last a life long.</p></aside>
<p>The boat itself is older than the bridge. It lay in a barn, dry and under straw, and needs little but paint.</p><h2>What it will cost</h2><p>A crossing is to cost as much as a bus ride, and nothing for children.</p></article>
<section class="related-articles"><h2>More on this</h2><ul><li><a href=/x>Bridge repairs delayed</a><li><a href=/y>Birds of the landing</a></ul></section></main>
<footer class=site-footer><ul><li><a href=/terms>Terms</a><li><a href=/privacy>Privacy</a></ul><p>Copyright 2022 The Weekly Bank</p></footer></body></html>""",
        ["Council votes to reopen the old ferry", "The ferry between the two banks, closed since the bridge was built, will run again from spring. The council voted nine to four on Monday night.",
         "Supporters spoke of the hour that a walk over the bridge takes. Others feared for the birds that nest on the landing.", "The boat itself is older than the bridge. It lay in a barn, dry and under straw, and needs little but paint.",
         "What it will cost", "A crossing is to cost as much as a bus ride, and nothing for children."],
    ),
    (
        """<html><body><div class="navbar"><a href="/">Docs</a> <a href="/api">API</a> <a href="/blog">Blog</a></div><div class="container"><div class="toc sidebar"><ul><li><a href="#i">Install</a></li><li><a href="#u">Use</a></li></ul></div>
<div class="main-content"><h1>Keeping bees on a roof</h1><p>A roof is warm, dry and out of reach of most who would disturb a hive. It also has wind.</p><h2>What you need</h2>
<ul><li>a hive that can be tied down</li><li>water within sight</li><li>a neighbour who likes honey</li></ul><p>Begin in late spring, when colonies swarm and cost little. Face the entrance away from the street.</p>
<p>Look in once a week; more often only makes them cross.</p></div></div><div class="newsletter"><form><p>Get our letter every month.</p><input><button>Subscribe</button></form></div>
<div class="footer">Made by the roof people. <a href="/legal">Legal</a></div></body></html>""",
        ["Keeping bees on a roof", "A roof is warm, dry and out of reach of most who would disturb a hive. It also has wind.", "What you need", "a hive that can be tied down", "water within sight", "a neighbour who likes honey",
         "Begin in late spring, when colonies swarm and cost little. Face the entrance away from the street.", "Look in once a week; more often only makes them cross."],
    ),
    (
        """<html><body><table width=100%><tr><td colspan=2><font size=5><a href=index.html>Village pages</a></font></td></tr><tr><td><ul class=menu><li><a href=a.html>History</a><li><a href=b.html>Church</a><li><a href=c.html>Inn</a></ul></td>
<td class=content><h1>The inn at the ford</h1><p>There was an inn here before there was a bridge, since travellers had to wait for the water to fall.<p>Its cellar floods still, each March, and the barrels are tied to the wall.<p>In 1740 the keeper was fined for selling beer during the sermon.</td></tr></table>
<p class=footer>Last changed in 2003. Mail the editor.</p></body></html>""",
        ["The inn at the ford", "There was an inn here before there was a bridge, since travellers had to wait for the water to fall.", "Its cellar floods still, each March, and the barrels are tied to the wall.", "In 1740 the keeper was fined for selling beer during the sermon."],
    ),
]
