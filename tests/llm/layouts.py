"""Hand-written page layouts with their main text; nothing of the trainer's code or words is used."""

A = "The council met on Tuesday evening to discuss the repair of the old stone bridge near the mill."
B = "Engineers had found deep cracks in two of its arches during the spring floods, and heavy lorries were sent on a longer road."
C = "Work should begin in September, said the mayor, provided that the county pays half of the cost."
D = "Several farmers asked for a temporary ferry, because the detour adds nearly an hour to every journey."
E = "No decision was taken on that proposal."
H = "Bridge over the river to be repaired"
S = "What the engineers found"
MENU = ["Home", "News", "Sports", "Contact"]
FOOT = "© 2021 Valley Herald. All rights reserved."


def p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def menu(items=MENU):
    return "<ul>" + "".join(f'<li><a href="/{i}">{t}</a></li>' for i, t in enumerate(items)) + "</ul>"


LONG = [f"{a} {b}" for a in ("Local", "World", "Market", "Garden", "School", "Travel") for b in ("news", "guide", "archive", "photos", "links")]

LAYOUTS = {
    "div only": (f"<html><body><div><div>{p(A, B, C)}</div></div></body></html>", [A, B, C]),
    "content id": (f'<html><body><div id="content"><h1>{H}</h1>{p(A, B)}</div></body></html>', [H, A, B]),
    "content id with parts": (f'<body><div id="nav">{menu()}</div><div id="content"><h1>{H}</h1>{p(A, B, C)}</div><div id="footer">{FOOT}</div></body>', [H, A, B, C]),
    "layout table": (f'<body><table><tr><td colspan=2>{menu()}</td></tr><tr><td><article><h1>{H}</h1>{p(A, B, C)}</article></td></tr><tr><td>Copyright 2021 Valley Herald</td></tr></table></body>', [H, A, B, C]),
    "table without names": (f"<body><table><tr><td>{menu()}</td><td><h1>{H}</h1>{p(A, B, C, D)}</td></tr></table><p>{FOOT}</p></body>", [H, A, B, C, D]),
    "article": (f"<body><header><a href=/>Valley Herald</a></header><nav>{menu()}</nav><article><h1>{H}</h1>{p(A, B)}<h2>{S}</h2>{p(C, D)}</article><footer>{FOOT}</footer></body>", [H, A, B, S, C, D]),
    "main without article": (f"<body><nav>{menu()}</nav><main><h2>{H}</h2>{p(A, B, C)}</main><aside><h3>Related articles</h3>{menu(['More bridges', 'Older floods'])}</aside></body>", [H, A, B, C]),
    "no headings": (f'<body><div class="menu">{menu()}</div><div class="post">{p(A, B, C, D, E)}</div><div class="footer">{FOOT}</div></body>', [A, B, C, D, E]),
    "long menu": (f'<body><div class="navigation">{menu(LONG)}</div><div class="entry-content"><h1>{H}</h1>{p(A, B, C)}</div></body>', [H, A, B, C]),
    "long menu without names": (f"<body><div>{menu(LONG)}</div><div><h1>{H}</h1>{p(A, B, C)}</div></body>", [H, A, B, C]),
    "comments inside the article": (f'<body><article><h1>{H}</h1>{p(A, B)}<div class="comments"><h3>3 comments</h3><p>Anna says</p><p>I think the ferry is a great idea, thanks.</p><p>Reply</p></div></article></body>', [H, A, B]),
    "comments after": (f'<body><main><h1>{H}</h1>{p(A, B, C)}</main><section id="comments"><h2>Leave a comment</h2><form><label>Name</label><button>Send</button></form></section></body>', [H, A, B, C]),
    "cookie notice": (f'<body><div class="cookie-banner"><p>We use cookies to improve your experience on this site.</p><button>Accept</button></div><div class="article-body"><h1>{H}</h1>{p(A, B, C)}</div></body>', [H, A, B, C]),
    "advert in the text": (f'<body><article><h1>{H}</h1><p>{A}</p><div class="ad">Advertisement: shop now and save 50% on garden chairs</div><p>{B}</p><p>{C}</p></article></body>', [H, A, B, C]),
    "list in the text": (f"<body><nav>{menu()}</nav><article><h1>{H}</h1><p>{A}</p><ul><li>{C}</li><li>{D}</li></ul><p>{E}</p></article></body>", [H, A, C, D, E]),
    "quote and caption": (f'<body><div id="main"><h1>{H}</h1><blockquote>{C}</blockquote><p>{A}</p><figure><img src=x><figcaption>{E}</figcaption></figure><p>{B}</p></div><div id="sidebar"><h3>Most read</h3>{menu()}</div></body>', [H, C, A, E, B]),
    "body only": (f"<html><body><h1>{H}</h1>{p(A, B, C)}</body></html>", [H, A, B, C]),
    "line breaks": (f'<body><div id="header">{menu()}</div><div class="text">{A}<br><br>{B}<br>{C}</div></body>', [f"{A} {B} {C}"]),
    "old markup": (f"<BODY><CENTER><FONT SIZE=5>{H}</FONT></CENTER><P>{A}<P>{B}<P>{C}<HR></BODY>", [H, A, B, C]),
    "share buttons": (f'<body><div class="story"><h1>{H}</h1><div class="share"><a href=f>Share on Facebook</a> <a href=t>Tweet</a></div>{p(A, B, C)}</div></body>', [H, A, B, C]),
    "newsletter form": (f'<body><main><h1>{H}</h1><p>{A}</p><form class="newsletter"><p>Subscribe to our newsletter</p><label>Email address</label><button>Sign up</button></form><p>{B}</p><p>{C}</p></main></body>', [H, A, B, C]),
    "sections of a main": (f"<body><header><nav>{menu()}</nav></header><main><section><h1>{H}</h1>{p(A, B)}</section><section><h2>{S}</h2>{p(C, D)}</section></main><footer><p>{FOOT}</p></footer></body>", [H, A, B, S, C, D]),
    "links in the text": (f'<body><div class="nav">{menu()}</div><div class="content"><h1>{H}</h1><p>{A} <a href=/m>The mill</a> was built in 1802.</p>{p(B, C)}</div></body>', [H, f"{A} The mill was built in 1802.", B, C]),
    "data table in the text": (f'<body><article><h1>{H}</h1><p>{A}</p><table><tr><th>Arch</th><th>Crack in cm</th></tr><tr><td>First arch</td><td>12</td></tr></table><p>{B}</p></article><footer>{FOOT}</footer></body>', [H, A, "Arch", "Crack in cm", "First arch", "12", B]),
    "meaningless names": (f'<body><div class="xkqz">{menu()}</div><div class="bvtr"><h1>{H}</h1>{p(A, B, C, D)}</div><div class="wqpf">{FOOT}</div></body>', [H, A, B, C, D]),
    "noscript": (f'<body><noscript>Please enable JavaScript to view this site</noscript><article><h1>{H}</h1><noscript><p>{A}</p></noscript>{p(B, C)}</article></body>', [H, A, B, C]),
    "wrapped": (f'<body><div class="wrapper"><div class="container"><div class="topbar">{menu()}</div><div class="row"><div class="post-content"><h1>{H}</h1>{p(A, B, C)}</div><div class="widget"><h4>Popular posts</h4>{menu()}</div></div></div></div></body>', [H, A, B, C]),
    "one paragraph": (f"<body><nav>{menu()}</nav><article><p>{B}</p></article><footer>{FOOT}</footer></body>", [B]),
}
