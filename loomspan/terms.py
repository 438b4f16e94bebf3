"""Words of ten languages that results depend on, by what they signal."""

from __future__ import annotations

# The terms of each kind, in order.
PRICE = (
    "₩", "$", "¥", "€", "£", "CHF", "SEK", "AUD", "CAD", "NZD", "DKK", "NOK", "USD", "EUR", "GBP", "JPY", "KRW", "kr", "R$", "원", "円", "元",
    "CNY", "RMB", "人民币",
)
RATING = (
    "★", "평점", "별점", "stars", "rating", "rated", "評価", "レビュー", "étoile", "Bewertung", "Sterne", "评分", "评价", "好评", "valoración",
    "estrellas", "valutazione", "stelle", "avaliação", "estrelas", "beoordeling", "sterren",
)
REVIEW_COUNT = (
    "개", "건", "리뷰", "review", "reviews", "レビュー", "件", "avis", "Bewertung", "Bewertungen", "Rezension", "条评论", "个评价", "条评价", "reseña",
    "reseñas", "opinión", "opiniones", "recensione", "recensioni", "avaliação", "avaliações", "beoordeling", "beoordelingen", "recensie",
    "recensies",
)
REPORTER = (
    "기자", "기고", "편집", "취재", "reporter", "記者", "編集", "journaliste", "rédacteur", "Reporter", "Journalist", "Redakteur", "记者", "编辑",
    "periodista", "redactor", "giornalista", "redattore", "jornalista", "redator", "journalist", "redacteur",
)
CONTACT = (
    "전화", "연락처", "주소", "팩스", "이메일", "tel", "address", "fax", "email", "電話", "住所", "téléphone", "adresse", "courriel", "Telefon", "Kontakt",
    "电话", "地址", "邮箱", "teléfono", "dirección", "correo", "telefono", "indirizzo", "email", "telefone", "endereço", "e-mail", "telefoon",
    "adres", "e-mail",
)
BRAND = (
    "브랜드", "제조사", "brand", "manufacturer", "ブランド", "メーカー", "marque", "fabricant", "Marke", "Hersteller", "品牌", "厂商", "marca", "fabricante",
    "marca", "produttore", "marca", "fabricante", "merk", "fabrikant",
)
DEPARTMENT = (
    "기관", "부처", "청", "위원회", "처", "원", "department", "ministry", "省", "庁", "委員会", "ministère", "département", "Ministerium", "Behörde",
    "Amt", "部门", "机构",
)
FEATURE = (
    "기능", "특징", "feature", "機能", "特徴", "fonctionnalité", "caractéristique", "Funktion", "Merkmal", "功能", "特点",
)
PRICING = (
    "요금", "가격", "price", "pricing", "₩", "$", "€", "価格", "料金", "prix", "tarif", "Preis", "Preise", "价格", "费用",
)
SEARCH_RESULT = (
    "검색결과", "개의 상품", "items", "건", "총 ", "search results", "results", "検索結果", "件の商品", "résultats", "produits", "Suchergebnisse",
    "Ergebnisse", "Produkte", "搜索结果", "个商品", "条宝贝",
)
LISTING = (
    "베스트", "랭킹", "인기", "신상품", "new arrival", "new in", "best", "ranking", "ベスト", "ランキング", "人気", "新着", "meilleures ventes", "nouveautés",
    "Bestseller", "Beliebt", "Neuheiten", "热销", "新品", "推荐",
)
FILTER = (
    "필터", "정렬", "카테고리", "filter", "sort", "category", "フィルター", "並び替え", "カテゴリー", "filtre", "tri", "catégorie", "Filter", "Sortieren",
    "Kategorie", "筛选", "排序", "分类",
)
AVAILABILITY = (
    "재고", "품절", "매진", "입고", "예약", "in stock", "out of stock", "sold out", "available", "unavailable", "limited", "pre-order", "在庫", "品切れ",
    "完売", "予約", "en stock", "épuisé", "disponible", "indisponible", "auf lager", "ausverkauft", "verfügbar", "nicht verfügbar", "库存", "缺货",
    "已售罄", "预订", "现货",
)
DISCOUNT = (
    "할인", "세일", "off", "sale", "discount", "引き", "割引", "remise", "réduction", "rabatt", "Preisnachlass", "折扣", "优惠", "满减",
)
OPTION = (
    "사이즈", "컬러", "색상", "옵션", "size", "color", "colour", "option", "サイズ", "カラー", "オプション", "taille", "couleur", "option", "Größe", "Farbe",
    "Option", "尺码", "颜色", "规格",
)
SHIPPING = (
    "무료배송", "무료 배송", "배송비", "당일배송", "내일 도착", "free shipping", "free delivery", "ships free", "delivery", "送料無料", "送料", "配送",
    "livraison gratuite", "livraison", "kostenloser versand", "versandkostenfrei", "lieferung", "包邮", "运费", "快递", "免运费",
)
NEXT_BUTTON = (
    "다음", "다음 페이지", "Next", "next", "Next Page", "next page", "次へ", "次のページ", "Suivant", "Page suivante", "Weiter", "Nächste Seite", "下一页",
    "下一步", "Siguiente", "Página siguiente", "Successivo", "Pagina successiva", "Próximo", "Próxima página", "Volgende", "Volgende pagina",
)
PREV_BUTTON = (
    "이전", "이전 페이지", "Previous", "previous", "Prev", "prev", "前へ", "前のページ", "Précédent", "Page précédente", "Zurück", "Vorherige Seite",
    "上一页", "上一步", "Anterior", "Página anterior", "Precedente", "Pagina precedente", "Anterior", "Página anterior", "Vorige",
    "Vorige pagina",
)
LOAD_MORE = (
    "더보기", "더 보기", "Load more", "Show more", "View more", "もっと見る", "さらに表示", "Voir plus", "Charger plus", "Mehr laden", "Mehr anzeigen",
    "加载更多", "查看更多", "Ver más", "Cargar más", "Carica altro", "Mostra altro", "Ver mais", "Carregar mais", "Meer laden", "Meer tonen",
)
SPONSORED = (
    "ad", "sponsored", "광고", "스폰서", "PR", "スポンサー", "広告", "publicité", "annonce", "anzeige", "gesponsert", "广告", "赞助", "patrocinado",
    "anuncio", "sponsorizzato", "pubblicità", "patrocinado", "gesponsord",
)
FREE_PRICE = (
    "free", "complimentary", "no charge", "무료", "공짜", "無料", "タダ", "gratuit", "offert", "kostenlos", "免费", "免費", "gratis", "gratuito",
    "grátis",
)
UNAVAILABLE_PRICE = (
    "sold out", "out of stock", "unavailable", "품절", "매진", "일시품절", "売り切れ", "品切れ", "在庫切れ", "épuisé", "indisponible", "ausverkauft",
    "nicht verfügbar", "已售罄", "缺货", "agotado", "esaurito", "esgotado", "uitverkocht", "coming soon", "notify me", "재입고 알림", "入荷待ち",
    "rupture de stock", "vergriffen", "暂无库存", "no disponible", "non disponibile", "indisponível", "niet beschikbaar",
)
FROM_PRICE = (
    "from", "starting at", "starting from", "부터", "から", "より", "à partir de", "depuis", "dès", "ab", "ab einem preis von", "起", "起价",
    "desde", "a partir de", "da", "a partire da", "vanaf", "v.a.",
)
ADD_TO_CART = (
    "장바구니", "장바구니 담기", "카트에 담기", "장바구니에 추가", "add to cart", "add to bag", "add to basket", "add item", "カートに入れる", "カートに追加", "買い物かごに入れる",
    "ajouter au panier", "ajouter au sac", "in den warenkorb", "in den einkaufswagen", "加入购物车", "加入購物車", "添加到购物车", "añadir al carrito",
    "agregar al carrito", "aggiungi al carrello", "adicionar ao carrinho", "in winkelwagen", "toevoegen aan winkelwagen",
)
BUY_NOW = (
    "바로구매", "즉시구매", "바로 구매", "지금 구매", "buy now", "buy it now", "purchase now", "今すぐ買う", "今すぐ購入", "acheter maintenant", "achat immédiat",
    "jetzt kaufen", "sofort kaufen", "立即购买", "立即購買", "马上购买", "comprar ahora", "acquista ora", "compra ora", "comprar agora", "nu kopen",
)
WISHLIST = (
    "위시리스트", "찜", "찜하기", "관심상품", "wishlist", "wish list", "save for later", "add to wishlist", "favorite", "favourites", "お気に入り",
    "ほしい物リスト", "ウィッシュリスト", "liste de souhaits", "ajouter aux favoris", "wunschzettel", "merkliste", "auf die wunschliste", "收藏", "加入收藏",
    "心愿单", "願望清單", "lista de deseos", "favoritos", "lista dei desideri", "preferiti", "lista de desejos", "favoritos", "verlanglijst",
    "favorieten",
)
QUANTITY = (
    "수량", "갯수", "개수", "qty", "quantity", "amount", "数量", "個数", "quantité", "qté", "menge", "anzahl", "数量", "數量", "cantidad", "quantità",
    "quantidade", "qtd", "aantal", "hoeveelheid",
)
SORT = (
    "정렬", "정렬기준", "정렬 기준", "sort", "sort by", "order by", "並べ替え", "並び順", "ソート", "trier", "trier par", "sortieren", "sortieren nach", "排序",
    "排列", "ordenar", "ordenar por", "ordina", "ordina per", "ordenar", "ordenar por", "sorteren", "sorteer op",
)
CART_CONFIRMATION = (
    "added to cart", "added to bag", "item added", "장바구니에 담았습니다", "장바구니에 추가", "장바구니 담기 완료", "カートに入れました", "カートに追加しました", "ajouté au panier",
    "article ajouté", "in den warenkorb gelegt", "zum warenkorb hinzugefügt", "已加入购物车", "已添加到购物车", "añadido al carrito",
    "aggiunto al carrello", "adicionado ao carrinho", "toegevoegd aan winkelwagen",
)

# Labels by locale - title, rating, brand, original price, discount, pagination, next available, page suffix, overflow, reviews, currency.
LABELS = {
    "ko": ("제목", "평점", "브랜드", "원가", "할인", "페이지네이션", "다음 있음", "페이지", "외 {n}건", "({n}개 리뷰)", "KRW"),
    "en": ("Title", "Rating", "Brand", "Original price", "Discount", "Pagination", "Next available", "pages", "+{n} more", "({n} reviews)", "USD"),
    "ja": ("タイトル", "評価", "ブランド", "定価", "割引", "ページネーション", "次あり", "ページ", "他{n}件", "({n}件のレビュー)", "JPY"),
    "fr": ("Titre", "Note", "Marque", "Prix d'origine", "Remise", "Pagination", "Suivant disponible", "pages", "+{n} de plus", "({n} avis)", "EUR"),
    "de": ("Titel", "Bewertung", "Marke", "Originalpreis", "Rabatt", "Seitennavigation", "Weiter verfügbar", "Seiten", "+{n} weitere", "({n} Bewertungen)", "EUR"),
    "zh": ("标题", "评分", "品牌", "原价", "折扣", "分页", "有下一页", "页", "还有{n}个", "({n}条评价)", "CNY"),
    "es": ("Título", "Valoración", "Marca", "Precio original", "Descuento", "Paginación", "Siguiente disponible", "páginas", "+{n} más", "({n} reseñas)", "EUR"),
    "it": ("Titolo", "Valutazione", "Marca", "Prezzo originale", "Sconto", "Paginazione", "Successivo disponibile", "pagine", "+{n} altri", "({n} recensioni)", "EUR"),
    "pt": ("Título", "Avaliação", "Marca", "Preço original", "Desconto", "Paginação", "Próximo disponível", "páginas", "+{n} mais", "({n} avaliações)", "BRL"),
    "nl": ("Titel", "Beoordeling", "Merk", "Oorspronkelijke prijs", "Korting", "Paginering", "Volgende beschikbaar", "pagina's", "+{n} meer", "({n} beoordelingen)", "EUR"),
}
NAMES = ("title", "rating", "brand", "original_price", "discount", "pagination", "next", "page_suffix", "overflow", "reviews", "currency")


def any_of(terms: tuple[str, ...]) -> str:
    """A regex that finds any of the terms as they stand, in Java's and RE2's syntax."""
    return "|".join("".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in t) for t in terms)
