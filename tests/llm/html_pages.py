"""Pages labelled by hand: (html, main text). None has an article or main element; main parts have names of other kinds, or none."""

_A = "The harbour office closed the east pier on Monday after divers found two cracked piles below the waterline."
_B = "Repairs will take about three weeks, the harbour master said, and ferries will use the west pier until then."
_C = "Local traders fear for the season, although most of them have been promised a place near the temporary landing."
_D = "When the pier was last repaired, in the spring of 1998, the works took twice as long as had been planned at first."

PAGES = [
    # A blog with class names.
    (
        f"""<html><head><title>Pier</title><script>if(a<b){{x='</p>'}}</script></head><body><div id="header" class="site-header"><a href="/">Home</a> <a href="/about">About</a></div>
<div class="wrap"><div class="post-content"><h1>East pier closed</h1><p>{_A}</p><p>{_B}</p><blockquote>{_C}</blockquote></div>
<div class="sidebar"><h3>Recent posts</h3><ul><li><a href="/1">One more day at sea</a></li><li><a href="/2">Fish prices fall</a></li></ul></div></div>
<div id="footer">Copyright 2021 The Harbour Blog. All rights reserved.</div></body></html>""",
        f"East pier closed\n{_A}\n{_B}\n{_C}",
    ),
    # No names at all: links and lengths tell.
    (
        f"""<body><div><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/c">Contact us</a></li></ul></div>
<div><h1>East pier closed</h1><p>{_A}</p><p>{_B}<p>{_C}<p>{_D}</div>
<div><p><a href="/t">Terms</a> | <a href="/p">Privacy</a></p></div></body>""",
        f"East pier closed\n{_A}\n{_B}\n{_C}\n{_D}",
    ),
    # Reader comments and an advert inside the main part.
    (
        f"""<body><div class="menu"><a href="/">Home</a><a href="/x">All stories</a></div><div class="story-body"><h1>East pier closed</h1><p>{_A}</p><div class="advertisement"><p>Buy the new season ticket today and save a third of the price!</p></div><p>{_B}</p>
<p>{_D}</p><div class="comments"><div class="comment"><p>I have seen this coming for years, and nobody at the office ever wanted to listen to us.</p></div><div class="comment"><p>Good riddance.</p></div></div></div></body>""",
        f"East pier closed\n{_A}\n{_B}\n{_D}",
    ),
    # Broken markup: no end tags, an apostrophe in a bare value, a comment in a script.
    (
        f"""<html><head><title>x</title><script>var s="<!--";</script><div class=nav data-x=it's><a href=/>Home</a> <a href=/a>Archive</a></div><div class=entry-content><h2>East pier closed</h2><p>{_A}<p>{_C}<p>{_D}</div>
<div class=cookie-notice><p>We use cookies to make this site work. By going on you agree to them.</div><div class=footer>Harbour Gazette 2020""",
        f"East pier closed\n{_A}\n{_C}\n{_D}",
    ),
    # Lists and headings in the main part, a form and a notice behind it.
    (
        f"""<body><div class="masthead">Harbour Gazette</div><div class="content"><h1>East pier closed</h1><p>{_A}</p><h2>What happens next</h2><ul><li>Ferries leave from the west pier, every hour on the hour.</li><li>The fish market stays where it is for the time being.</li></ul><p>{_D}</p></div>
<form action="/s"><label>Your mail address</label><input><button>Subscribe</button></form><div class="related"><h4>More on this</h4><a href="/q">Pier repairs cost more than thought</a></div></body>""",
        f"East pier closed\n{_A}\nWhat happens next\nFerries leave from the west pier, every hour on the hour.\nThe fish market stays where it is for the time being.\n{_D}",
    ),
    # A wrapper named by an id, share buttons and a newsletter box between.
    (
        f"""<body><div id="top-nav"><a href="/1">Start</a><a href="/2">Region</a><a href="/3">Weather</a></div><div id="page"><div id="story"><h1>East pier closed</h1><div class="share-buttons"><a href="#">Share</a><a href="#">Tweet</a></div><p>{_A}</p><p>{_B}</p><div class="newsletter"><p>Get our letter every morning.</p></div><p>{_C}</p></div></div><div class="copyright">All rights reserved.</div></body>""",
        f"East pier closed\n{_A}\n{_B}\n{_C}",
    ),
]
