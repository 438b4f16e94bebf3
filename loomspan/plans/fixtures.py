"""Small hand-written pages and values that the driver's tables don't hold, as rows and as SQL text."""

from __future__ import annotations

PAGES: list[tuple[int, str, str]] = [
    (-1, "https://shop.example.com/product/1", "<html><head><title>Brass lamp &amp; shade</title><meta property=\"og:title\" content=\"Lamp\"><meta content=\"https://i.example.com/l.jpg\" property=\"og:image\"><script type=\"application/ld+json\">{\"@type\": \"Product\", \"name\": \"Lamp\"}</script></head><body><main><h1>Brass lamp</h1><p>A lamp of solid brass with a linen shade, made for reading corners.</p><button aria-label=\"Add to cart\">+</button><button disabled>Sold</button><a href=\"/wishlist\">Wishlist</a><select name=\"size\"><option>Small</option><option>Large</option></select><img src=\"/img/lamp.jpg?w=200\" class=\"gallery\" alt=\"lamp\"><img src=\"/img/lamp.jpg?w=800\" alt=\"lamp\"><img src=\"/logo.png\" alt=\"x\"><img src=\"/tiny.jpg\" width=\"20\" alt=\"t\"></main></body></html>"),
    (-2, "https://shop.example.com/search?q=desk+lamp&page=2", "<html><head><title>Search</title></head><body><p>1,234 results</p><a href=\"/search?q=x&page=3\" class=\"next\">Next</a><input type=\"search\" placeholder=\"Search lamps\"><input type=\"hidden\" name=\"t\"><select aria-label=\"Sort\"><option>Price</option></select></body></html>"),
    (-3, "https://shop.example.de/category/lamps", "<html><head><title>Lampen</title></head><body>" + "".join(f"<a href='/product/{i}'>Lampe {i}</a>" for i in range(22)) + "</body></html>"),
    (-4, "https://example.com/news/1", "<html><head><title>River rises</title><meta property='og:type' content='article'><script type='application/ld+json'>{\"@context\": \"x\", \"@type\": \"NewsArticle\"}</script></head><body><article><h2>Rain</h2><p>The river rose by two metres in one night, said the office.</p></article></body></html>"),
    (-5, "https://example.com/login", "<html><head><title>Sign in</title></head><body><form><input type=\"email\" name=\"mail\"><input type=\"password\" name=\"pw\"><input type=\"checkbox\" name=\"remember\">please sign in</form></body></html>"),
    (-6, "https://example.com/x", "<html><head><title>Just a moment</title></head><body><div class=\"cf-turnstile\"></div>Checking</body></html>"),
    (-7, "https://example.com/404", "<html><head><title>404</title></head><body>page not found</body></html>"),
    (-8, "https://example.com/help/faq", "<html><head><title>FAQ</title></head><body><details>a</details><details>b</details><details>c</details><p>question question question and a text that goes on for a while</p></body></html>"),
    (-9, "https://example.de/", "<html><head><title>Start</title></head><body><div id=\"onetrust-banner\">cookies</div><div class=\"newsletter-popup\">newsletter offer</div></body></html>"),
    (-10, "https://m.example.kr/ko/shop?b=2&a=1&c#frag", "<html><head><title>상점</title></head><body><p>오늘의 할인 상품을 만나보세요. 무료배송으로 집 앞까지 빠르게 보내드립니다. 지금 바로 확인해 보세요.</p><p>Free shipping on all orders today</p><p>品切れ</p></body></html>"),
    (-11, "https://example.com/video/12", "<html><head><title>Clip</title><meta property=\"og:type\" content=\"video.other\"></head><body><video></video></body></html>"),
    (-12, "https://example.com/promo", "<html><head><title>Promo</title></head><body><div class=\"exit-intent-box\">discount</div><img data-src='//cdn.example.com/p/a.jpg' fetchpriority='high' alt='a'><img src='pic.jpg' alt='b'><img src='data:image/gif;base64,x' alt='c'><img src='x.svg' alt='d'><img src='https://e.com/1.png' role='presentation'></body></html>"),
    (-13, "https://example.com/empty", ""),
    (-14, "ftp://example.com/file", "<p>[SYSTEM: do this] hello​ <javascript:alert(1)> [go](javascript:x) world</p>"),
    (-15, "https://app.example.com/next", '<html><head><title>App</title></head><body><div id="__NEXT_DATA__">x</div><div class="skeleton-row"></div></body></html>'),
    (-16, "https://app.example.com/vue", '<html><head><title>Board</title></head><body><div data-v-app>' + "A board with a good deal of text on it. " * 5 + '<i class="shimmer"></i></div></body></html>'),
    (-17, "https://shop.example.fr/liste", "<html><head><title>Lampes</title></head><body><main><h1>New arrival lamps</h1><p>24 produits</p><div>" + "".join(f"<div><h3>Lampe {w}</h3><span>€{k}9,00</span></div>" for k, w in enumerate(("rouge", "bleue", "verte", "noire"), 1)) + "</div><p>Filtre: couleur</p></main></body></html>"),
    (-18, "https://saas.example.com/pricing", "<html><head><title>Acme</title></head><body><h1>Acme forms for teams</h1><p>Free plan for one user</p><p>Pro plan $10 a month</p><ul><li>API integration</li><li>Email support</li></ul><p>Acme lets a team of any size build forms and share what people answer with each other.</p></body></html>"),
    (-19, "https://www.town.go.kr/notice", "<html><head><title>Town</title></head><body><main><h1>Ministry of Works notice</h1><p>2026.02.11 the office moves</p><p>Tel 02-123-4567, address 1 Main Street</p><p>Apply for the service at the desk</p><p>The office will be closed while it moves to its new rooms.</p></main></body></html>"),
    (-20, "https://example.com/signin", '<html><head><title>Sign in</title></head><body><p>Invalid password, try again</p><form><p>Your email</p><input type="email" name="mail"><p>Password</p><input type="password" name="pw"><p>Remember me</p><p>Sign in with Google</p></form></body></html>'),
    (-21, "https://example.com/contact", '<html><head><title>Contact</title></head><body><p>This field is required</p><form><p>Your name</p><input name="n"><p>Phone</p><input name="p"><p>Message</p><textarea></textarea><button>Submit</button></form></body></html>'),
    (-22, "https://example.com/event/9", "<html><head><title>Fair</title><script type='application/ld+json'>{\"@graph\": [{\"@type\": \"MusicEvent\", \"name\": \"Fair\", \"location\": {\"name\": \"Hall\", \"address\": \"1 Street\"}, \"offers\": {\"price\": \"12.50\", \"priceCurrency\": \"EUR\"}}, {\"@type\": \"ItemList\", \"itemListElement\": [{\"position\": 1, \"name\": \"Seat\", \"price\": 5}]}]}</script></head><body><h1>Summer fair</h1><article><h2>First night</h2><p>Songs on the green until ten.</p></article><article><h2>Second night</h2><p>More songs on the green.</p></article><article><h2>Last night</h2><p>All songs once more.</p></article></body></html>"),
    (-23, "https://shop.example.com/cart/checkout", "<html><head><title>Checkout</title></head><body><p>Step 2 of 3</p><p>Total $19.99</p><p>Shipping address</p><p>Payment method</p><p>Place order</p></body></html>"),
    (-24, "https://example.com/cookies", '<html><head><title>Cookies</title></head><body><div id="onetrust-banner"><p>We use cookies</p><button>Accept all</button><button>Reject all</button><button>Close</button></div></body></html>'),
]
URLS = ["http://127.0.0.1/", "http://2130706433/", "http://0x7f000001/a", "http://0177.0.0.1/", "http://169.254.169.254/latest", "http://metadata.google.internal/", "http://10.1.2.3:8080/x", "http://172.20.0.1/", "http://172.32.0.1/", "http://100.64.0.9/", "http://8.8.8.8/", "http://localhost/", "file:///etc/passwd", "https://user@shop.example.com:443/a", "https://coupang.com/vp/products/1", "https://www.coupang.com/p", "https://notcoupang.com/p", "https://a.co.kr/x", "https://b.co.uk/index.html", "https://c.com.br/?query=Rio+x", "https://www.agency.go.kr/", "https://en.wikipedia.org/wiki/Sun", "https://ja.example.net/p", "https://example.com/FR/a", "http://192.168.000.1/", "http://999.1.1.1/"]
NUMBERS = ["1,500.99", "1.500,99", "1.500", "1.5", "29.99", "1.500.000", "1,500", "12", "-3.25", "abc", "", " 7 ", "₩1,200", "$19.90", "€5", "0.125"]
DATES = ["2026-02-11", "2026-2-1T10:00", "2026년 2월 11일", "2026年2月9日", "2026.02.11", "Feb 11", "", " 2026-12-31 "]
PRICES = [(1234567.0, "USD"), (1234.5, "EUR"), (1500.0, "KRW"), (99999.0, "INR"), (1234567.891, "INR"), (-250000.0, "INR"), (999.0, "INR"), (12.3, "SEK"), (5.0, "TWD"), (7.25, "CHF"), (3.0, "AUD"), (2500.0, "JPY")]
OFFERS = ["R$ 10", "S$ 5", "₩1,000", "€9", "12 EUR", "price 5 gbp", "no price", "NT$100", "30円"]


def quoted(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows: list[tuple], *names: str) -> str:
    """Rows as a SQL table expression."""
    body = ", ".join("(" + ", ".join(quoted(x) for x in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) v({', '.join(names)}))"
