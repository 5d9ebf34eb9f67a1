"""A small table of URLs labelled by hand, for the registered URL filter: what a crawl of prose should and should not take.

Fixed values: addresses are invented and follow the habits of such sites; a deployment passes its own table. Hosts carry the labels,
so both classes stand with the same paths.
"""

TAKE = """
www.town-library.example.net
blog.riverside.example.com
news.northern-times.example.net
m.garden-notes.example.com
recipes.homekitchen.example.net
www.thearth.example.com
theresin.example.net
blog.thington.example.net
m.ththre.example.com
www.ernding.example.net
thorand.example.com
blog.tiontha.example.net
www.tionand.example.com
haredst.example.net
m.stlyes.example.com
www.wheare.example.net
blog.nthour.example.com
ouather.example.net
www.university-press.example.net
history.museum.example.com
docs.openproject.example.net
www.daily-weather.example.com
forum.woodwork.example.net
encyclopedia.example.com
schule-am-berg.example.net
www.city-council.example.com
blog.physics-notes.example.net
poems.old-books.example.com
m.trainspotter.example.net
www.health-service.example.com
reviews.cinema.example.net
www.hikers.example.com
mathclub.example.net
www.birdwatch.example.com
archive.letters.example.net
blog.bakery.example.com
www.rowing-club.example.net
translations.example.com
www.astronomy.example.net
m.local-radio.example.com
www.farm-shop.example.net
free-software.example.com
www.track-and-field.example.net
winter-sports.example.com
adult-education.example.net
www.pharmacy-school.example.com
letter-box.example.net
blog.thernd.example.com
m.ththed.example.net
tionsh.example.net
www.thering.example.com
ththon.example.com
m.ereran.example.net
blog.ander.example.net
inghe.example.com
""".split()

LEAVE = """
www.casino-royal.example.com
casino-bonus.example.net
m.mega-casino.example.com
win-cash.example.net
www.jackpot-win.example.com
slots-win.example.net
poker-bets.example.com
blog.sports-bets.example.net
bets-online.example.com
free-spins.example.net
free-iphone.example.com
www.free-money.example.net
cheap-meds.example.com
cheap-watches.example.net
m.cheap-loans.example.com
diet-pills.example.net
buy-pills.example.com
www.pills-online.example.net
viagra-shop.example.com
replica-bags.example.net
adult-cams.example.com
adult-dating.example.net
www.xxx-videos.example.com
porn-tube.example.net
sex-x.example.com
escort-x.example.net
ads-server.example.com
popup-ads.example.net
click-ads.example.com
ad-track.example.net
link-track.example.com
pixel-track.example.net
spam-links.example.com
www.spam-seo.example.net
link-farm.example.com
content-farm.example.net
click-farm.example.com
payday-loans.example.net
crypto-doubler.example.com
lottery-winner.example.net
hot-singles.example.com
weight-loss-miracle.example.net
cracked-keys.example.com
warez-downloads.example.net
www.essay-mill.example.com
buy-followers.example.net
fake-passport.example.com
""".split()

PATHS = """
/en/12 /en/120.html /en/405/ /en/articles/44 /de/77 /de/9.html /de/640/ /de/archiv/3
/fr/410 /fr/18.html /fr/71/ /fr/pages/21 /es/318 /es/7.html /es/22/ /es/cuentos/61 / /index.html
""".split()

#: Every host with every third path, each host one path further on than the one before.
LABELLED = [(f"https://{host}{PATHS[(i + 3 * k) % len(PATHS)]}", label) for label, hosts in ((0, TAKE), (1, LEAVE)) for i, host in enumerate(hosts) for k in range(6)]
SCHEMA = "url string, blocked int"
