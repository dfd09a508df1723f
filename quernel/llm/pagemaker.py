"""Random labelled pages for training the block labeller: (html, labels of its blocks in order).

Regions of boilerplate stand where sites put them, marked by tags, class or id
names, or both; main text has headings, paragraphs, lists, quotes and tables,
closed or not.  Texts are invented words, so that position, path and shape decide.
"""

from __future__ import annotations

import random

# Words that class and id names of a region are made of.
NAMES = {
    "nav": "nav navbar menu navigation breadcrumb topbar main-menu site-nav pagination toc links",
    "header": "header masthead site-header branding logo top page-header",
    "footer": "footer site-footer bottom colophon copyright legal foot",
    "side": "sidebar aside widget related rail recommended popular side more-stories trending secondary",
    "notice": "cookie cookie-banner consent gdpr notice alert popup modal paywall overlay message cookies-notice",
    "ad": "ad ads advert advertisement sponsored promo banner-ad sponsor adbox ad-slot promotion",
    "form": "form newsletter subscribe search login signup contact-form search-box",
    "share": "share social share-buttons tags follow social-links",
    "comments": "comments comment comment-list replies respond discussion reader-comments comment-body responses reply",
    "main": "content article post entry main story body text article-body post-content entry-content copy prose",
    "plain": "wrapper container row col inner wrap grid layout section block box page site",
}
TAGS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "notice": "div dialog section", "ad": "div aside ins section", "form": "form", "share": "div ul", "comments": "section div ol", "main": "article main div section"}
PHRASES = {
    "nav": "home about contact news sport login shop help blog next previous",
    "header": "welcome subscribe menu search daily",
    "footer": "copyright privacy terms imprint rights reserved contact",
    "side": "related popular latest more trending archive",
    "notice": "cookies accept consent privacy settings we use agree",
    "ad": "advertisement sponsored buy now offer sale",
    "form": "email name password search submit send subscribe",
    "share": "share tweet print email follow tags",
    "comments": "says reply comments wrote posted ago report",
}
_SYLLABLES = "the er in on an re th he at en nd ti es or is ed it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ä ö ü ß é è ñ í ó ç que eau lich schwer".split()


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.out: list[str] = []
        self.labels: list[int] = []
        self.style = 0.0

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def sentence(self, low: int = 3, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.4 and len(words) > 4:
            words[self.r.randrange(1, len(words) - 1)] += ","
        return words[0].capitalize() + " " * (len(words) > 1) + " ".join(words[1:]) + "."

    def prose(self) -> str:
        style = self.style if self.r.random() < 0.9 else self.r.random()
        text = " ".join(self.sentence(1 if style > 0.8 else 3) for _ in range(self.r.choice([1, 1, 2, 3, 5, 8, 14])))
        if style < 0.06:
            text = " ".join(w + self.r.choice(["***", "###", "$$$", "%%%", "&amp;&amp;"]) for w in text.split())
        elif style < 0.10:
            text = text.upper()
        elif style < 0.16:
            text = " | ".join(text.split())
        elif style < 0.20:
            text = " ".join([self.word()] * self.r.randint(1, 60))
        elif style < 0.24:
            text = self.word() if self.r.random() < 0.5 else " ".join(self.word() for _ in range(self.r.randint(1, 6)))
        elif style < 0.27:
            text = text.lower().replace(".", "").replace(",", "")
        return text

    def text(self, kind: str) -> str:
        r = self.r
        if kind in ("nav", "share"):
            words = [self.word() for _ in range(r.randint(1, 2))]
        elif r.random() < 0.5 or kind in ("ad", "comments", "notice", "footer", "header"):
            return " ".join([*([r.choice(PHRASES[kind].split()).capitalize()] if r.random() < 0.3 else []), *(self.sentence(1, 14) for _ in range(r.choice([1, 1, 1, 2, 3])))])
        else:
            words = [self.word() for _ in range(r.randint(1, 8))]
        if r.random() < 0.3:
            words[0] = r.choice(PHRASES[kind].split())
        return " ".join(words)

    def block(self, tag: str, text: str, label: int, close: float = 0.97) -> None:
        self.out.append(f"<{tag}>{text}" + (f"</{tag.split()[0]}>" if self.r.random() < close else ""))
        self.labels.append(label)

    def open(self, kind: str, hint: float = 0.8) -> str:
        r = self.r
        tag = r.choice(TAGS[kind].split()) if r.random() < 0.7 else "div"
        named = r.random() < hint or tag in ("div", "section", "ul", "ol", "ins")
        attr = ""
        if named:
            name = r.choice(NAMES[kind].split())
            if r.random() < 0.3:
                name += " " + r.choice(NAMES["plain"].split())
            attr = f' {r.choice(["class", "class", "class", "id"])}="{name}"'
        self.out.append(f"<{tag}{attr}>")
        return f"</{tag}>"

    def region(self, kind: str) -> None:
        r = self.r
        end = self.open(kind)
        if kind == "nav" or kind in ("side", "share", "footer", "header") and r.random() < 0.4:
            self.out.append("<ul>")
            for _ in range(r.randint(2, 8)):
                self.block("li", f'<a href="/{self.word()}">{self.text("nav")}</a>', 0)
            self.out.append("</ul>")
        if kind == "ad" or kind == "footer" or r.random() < 0.2:
            self.out.append(("&copy; " if kind == "footer" and r.random() < 0.6 else "") + self.text(kind))
            self.labels.append(0)
        elif kind == "comments":
            if r.random() < 0.6:
                self.block(r.choice(["h2", "h3"]), r.choice(["Comments", "Replies", self.text(kind)]), 0)
            for _ in range(r.randint(1, 6)):
                inner = r.random() < 0.5
                self.out.append(f'<{"li" if inner else "div"} class="{r.choice(NAMES[kind].split())}">')
                if r.random() < 0.5:
                    self.block("div", self.word() + " " + r.choice(PHRASES[kind].split()), 0)
                self.block("p", self.prose() if r.random() < 0.6 else self.text(kind), 0)
                self.out.append("</li>" if inner else "</div>")
        elif kind == "form":
            for _ in range(r.randint(1, 3)):
                self.block(r.choice(["label", "p", "div"]) if r.random() < 0.9 else "h3", self.text(kind), 0)
            self.out.append('<input type="text">')
        elif kind != "nav":
            if r.random() < 0.5:
                self.block(r.choice(["h2", "h3", "h4", "p"]), self.text(kind), 0)
            for _ in range(r.randint(1, 3)):
                self.block(r.choice(["p", "div", "p"]), self.prose() if r.random() < 0.3 else self.text(kind), 0)
        self.out.append(end)

    def main(self) -> None:
        r = self.r
        end = self.open("main", 0.5)
        title = self.sentence(2, 12)
        if r.random() < 0.85:
            self.block("h1", title, 1)
        if r.random() < 0.3:
            self.out.append(f"<p><b>{title}<br>")
            self.labels.append(1)
        n = r.choice([1, 2, 3, 4, 6, 8, 12, 16])
        wrapped = r.random() < 0.25
        if wrapped:
            self.out.append(f'<div class="{r.choice(NAMES["main"].split())}">')
        for _ in range(n):
            x = r.random()
            if x < 0.72:
                self.block("p", self.prose(), 1, 0.93)
            elif x < 0.80:
                self.block(r.choice(["h2", "h3", "h4"]), self.sentence(1, 8), 1)
            elif x < 0.87:
                tag = r.choice(["ul", "ol"])
                self.out.append(f"<{tag}>")
                for _ in range(r.randint(1, 6)):
                    self.block("li", self.prose() if r.random() < 0.5 else self.sentence(1, 8), 1, 0.9)
                self.out.append(f"</{tag}>")
            elif x < 0.91:
                self.block("blockquote", self.prose(), 1)
            elif x < 0.94:
                self.block("div", self.prose(), 1)
            elif x < 0.96:
                self.block("pre", self.prose(), 1)
            elif x < 0.98:
                self.out.append("<table>")
                for _ in range(r.randint(1, 3)):
                    self.out.append("<tr>")
                    for _ in range(r.randint(1, 3)):
                        self.block(r.choice(["td", "th"]), self.sentence(1, 4), 1)
                    self.out.append("</tr>")
                self.out.append("</table>")
            else:
                self.out.append("<figure>")
                self.block("figcaption", self.sentence(1, 9), 1)
                self.out.append("</figure>")
            if r.random() < 0.08:
                self.region(r.choice(["ad", "ad", "share", "side", "form", "notice", "nav"]))
        if wrapped:
            self.out.append("</div>")
        if r.random() < 0.15:
            self.region("share")
        if r.random() < 0.15:
            self.region("comments")
        self.out.append(end)

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        self.out, self.labels, self.style = [], [], r.random()
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.sentence()}</title><style>p{{}}</style></head><body>")
        wraps = r.choice([0, 0, 1, 2])
        for _ in range(wraps):
            self.out.append(f'<div class="{r.choice(NAMES["plain"].split())}">')
        for kind, chance in (("notice", 0.25), ("header", 0.45), ("nav", 0.75), ("ad", 0.4), ("form", 0.15), ("side", 0.15)):
            if r.random() < chance:
                self.region(kind)
        self.main()
        for kind, chance in (("share", 0.15), ("comments", 0.3), ("ad", 0.2), ("side", 0.35), ("form", 0.25), ("notice", 0.12), ("nav", 0.1), ("footer", 0.8)):
            if r.random() < chance:
                self.region(kind)
        self.out += ["</div>"] * wraps + ["</body></html>"]
        return "".join(self.out), self.labels
