"""The labelled URL table of the URL filter: rows composed by rule from word lists, the same at every call.

Unwanted (1) are hosts or paths with words of gambling, adult, pill, loan, spam, tracking or piracy sites; ordinary (0) is the rest: hosts of common
words, of made-up syllables and of words that merely contain an unwanted one (Essex, diabetes), and empty urls. No list of real sites is used.
"""

from __future__ import annotations

import random

# fixed values: words of unwanted sites, by theme
UNWANTED = {
    "gambling": "casino poker roulette jackpot slots bets betting gambling gamble blackjack baccarat lottery wager sportsbook bingo spins highroller",
    "adult": "porn xxx adult sex sexy escort escorts nude nudes webcams camgirls hentai erotic fetish milf hookup hotgirls",
    "pills": "viagra cialis pills pharmacy-online meds tramadol xanax steroids weightloss dietpills painkillers levitra",
    "money": "payday loans fastcash easy-money get-rich forex-signals crypto-doubler debt-relief earn-fast binary-options free-bitcoin",
    "spam": "spam link-farm linkfarm seo-links buy-followers buy-likes free-traffic spam-farm clickbait fake-reviews backlinks",
    "tracking": "ads adserver ads-track tracker tracking-pixel clicktrack popads adclick banner-ads popunder doubleclicks affiliate-click",
    "piracy": "warez torrent torrents keygen cracked serials free-movies nulled pirated full-download cracks hacktool",
}
# fixed values: words of ordinary sites
ORDINARY = (
    "news library museum weather garden history science recipes travel school university music theatre cinema market bakery village harbour river mountain "
    "forest ocean island bridge station railway airport cycling running football tennis chess painting pottery knitting photo camera radio journal review "
    "magazine daily times post herald tribune gazette observer guardian chronicle software python data cloud server network code docs guide manual wiki "
    "forum blog shop store books cards maps food coffee kitchen wine cheese bread garden-club bank insurance law health clinic hospital dentist doctor "
    "mail email message phone mobile chat children family home house design studio gallery art craft fashion shoes jewels watch car auto motor bike boat flight hotel camping tours guidebook "
    "nature animals birds horses dogs cats aquarium zoo farm dairy fruit flowers trees energy solar wind water climate space stars planet physics biology "
    "chemistry maths research institute college academy council city county state nation parliament police fire rescue army navy church temple charity "
    "trust fund jobs career office paper print press media film video games toys puzzle dance opera orchestra festival events tickets calendar free cheap "
    "online win live direct best top my the open world global local green blue red north south east west first new old big little easy fast smart"
).split()
# fixed values: ordinary words that contain an unwanted one or a part of it
MISLEADING = (
    "essex sussex middlesex sextant sextet bisexual-health sexton unisex adulthood adult-education betty alphabet beta betterment diabetes tibet abetting "
    "caterpillar pillow pillar pillows spillway slotcar timeslots spinach spinning lotterby pokerface-museum adsorption roadside broadside leads loads "
    "downloads uploads threads beads headset nudesign denude nudge analytics spamfritters malware-research crackers nutcracker firecracker hackathon "
    "trackpad trackside racetrack soundtrack eyetracker medsci comedies remedies medal payroll paydayhistory linkage hyperlinks cocktail escortmk2 fordescort "
    "bingley gambler-novel grapes therapist skyscraper cheapflights freedom windows winter winery drugstore pharmacology lolita-novel"
).split()
TLDS = "com org net info co.uk de fr es eu io edu example example.com example.net".split()
SUBDOMAINS = ("", "", "www.", "m.", "blog.", "en.", "news.")
SYLLABLES = "tha ther tion ing ble ness ent ary mo li ra ko ven dar sil fa bri no the ou st ha re ed on th er le ter ma pi sa to lu gre va nor wen col tan bel kri zu ya".split()
PATHS = ("", "/", "/en/{n}", "/fr/{n}.html", "/de/{n}/", "/es/{n}", "/index.html", "/wiki/{w}_{v}", "/{y}/05/{w}-{v}", "/{w}/{v}", "/page/{n}", "/{w}.php", "/about", "/articles/{n}/{w}", "/user/{w}/{v}", "/apache/{w}")
UNWANTED_PATHS = ("/{u}", "/{u}/{n}", "/free-{u}.html", "/{w}/{u}", "/{u}-online", "/play/{u}", "/watch/{u}/{n}", "/buy-{u}", "/{u}?id={n}", "/best-{u}-{w}")


def rows(ordinary: int = 5000, unwanted: int = 3000, seed: int = 5) -> tuple[tuple[str, int], ...]:
    """(url, label) of so many ordinary and unwanted urls."""
    rng = random.Random(seed)
    bad = [w for words in UNWANTED.values() for w in words.split()]

    def made_up() -> str:
        return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 4)))

    def plain() -> str:
        return rng.choice([rng.choice(ORDINARY), rng.choice(ORDINARY), made_up(), rng.choice(MISLEADING)])

    def filled(path: str) -> str:
        return path.format(n=rng.randrange(10_000), y=rng.randrange(2005, 2025), w=plain(), v=plain(), u=rng.choice(bad))

    def url(name: str, path: str) -> str:
        return f"{rng.choice(['http', 'https'])}://{rng.choice(SUBDOMAINS)}{name}.{rng.choice(TLDS)}{path}"

    out = [("", 0)] * 40
    for _ in range(ordinary):
        name = rng.choice(["{}", "{}-{}", "{}{}", "the{}", "{}-online"]).format(plain(), plain())
        out.append((url(name, filled(rng.choice(PATHS))), 0))
    for _ in range(unwanted):
        word = rng.choice(bad)
        name = rng.choice([f"{word}", f"{word}-{plain()}", f"{plain()}-{word}", f"{plain()}{word}", f"{word}{plain()}", f"{word}-{rng.choice(bad)}", f"{word}-{rng.choice('xz79')}", f"free-{word}"])
        kind = rng.random()
        if kind < 0.65:
            out.append((url(name, filled(rng.choice(PATHS))), 1))
        elif kind < 0.85:
            out.append((url(name, filled(rng.choice(UNWANTED_PATHS))), 1))
        else:
            out.append((url(plain(), filled(rng.choice(UNWANTED_PATHS)) + "/" + rng.choice(bad)), 1))
    return tuple(out)
