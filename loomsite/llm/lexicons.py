"""General word lists of abusive, hateful and sexual language in four languages, for normalised lower-case words.

Fixed values: single words of general use. An entry that ends in `*` stands for every word that begins
with it. Words before the bar tell much by themselves, those after it only together with others.
"""

WORDS = {
    "abusive": """
    idiot* moron* imbecil* scum scumbag* bastard* bitch* arsehole* asshole* dickhead* dimwit* halfwit* nitwit* dumbass* jackass retard* loser* cretin* wanker* twat fucker* motherfucker* fuck* douche* shithead* lowlife* braindead sissy
    vollidiot* arschloch* wichser* trottel* schwachkopf* mistkerl* abschaum versager* hurensohn* drecksack* depp* miststück missgeburt
    gilipollas pendejo* cabrón cabron* imbécil* escoria malnacid* hijoputa subnormal*
    connard* connasse* abruti* crétin* salaud* ordure* enculé* débile* minable*
    | clown* fool* jerk* coward* freak* creep* parasite* pig pigs rat trash garbage stupid* worthless pathetic useless dumb ugly disgusting ashamed hate hates hated die dies dead choke rot kill kills beat smash burn punch stab strangle hunt crush hurt suffer shut pest nobody brain brainless disappear begone gutless spineless
    dumm* wertlos* erbärmlich* nutzlos* hässlich* feigling* halt klappe fresse verschwinde* verrecke* umbringen schlag* hasst hassen keiner niemand schämen ekelhaft*
    estúpid* inútil* tont* basura maldit* feo asqueros* cobarde* cállate muérete matar romper cara odia odian nadie desaparec* vergüenza pena
    stupide* inutile* idiote* laid lâche* dégoûtant* crève* crever gueule casser figure tuer déteste* haïssent personne disparais* honte pauvre ferme
    """,
    "hateful": """
    vermin subhuman* untermensch* cockroach* mongrel* savages infest* exterminat* eradicat* deport* ethnic genocid* inferior lynch* gas
    ungeziefer minderwertig* ausrotten vertreiben vertrieben abschieben volksfremd* schmarotzer* untermenschen
    alimañ* plaga infrahuman* exterminar deportar expulsar echarl* inferiores
    vermine sous-hommes exterminer expulser chasser inférieurs nuisibles
    | filth filthy dirt dirty rats rat breed breeding cage animals beasts plague disease infect* pure impur* taint* contaminat* pollut* defil* blood criminals thieves theft steal invaders purge cleanse expel ban driven country belong lesser
    dreckig* schmutz* ratten blut tiere stehlen gestohlen kriminell* pack raus land gehören
    sucios ratas sangre animales robar ladrones país fuera bestias
    sales rats sang bêtes voler voleurs pays dehors animaux
    """,
    "sexual": """
    porn* hardcore xxx horny nude* nudes erotic* erotik* escort* orgasm* blowjob* cum cumshot* milf* hentai fetish* stripper* camgirl* slutty threesome* gangbang* pussy cock dildo* masturbat* fuckable
    geile* geil nackte* fick* titten pornos muschi schwanz
    desnud* follar cachond* pornograf* tetas polla
    salope* bite baiser branler chaudes nues
    | sex sexy sexual love lover* passion* naked cam cams webcam* adult adults singles couples amateurs explicit uncensored undress* moan* tongue bed lips breasts thighs kiss* lust* desire* seduc* intimate taboo* tonight hot strip body picture* photo* video* nackt heiß* heiße tabus bett unzensiert* paare frauen lust küss*
    sexo caliente* solteras cama censura chicas videochat cuerpo besos
    sexe nu nus coquin* célibataires lit tabou* censure filles chaude chaud corps baisers
    """,
}
#: Words of reporting, quoting, forbidding, medicine, technique and nature, in which the words above mean no harm.
CONTEXT = """
report* moderat* remov* delet* essay* article* document* histor* newspaper* quot* excerpt* rule* forbid* forbidden banned policy policies filter* block* guideline* research* stud* survey* court* police law warn* prevent* awareness educat*
clinic* health* medic* doctor* nurse* therap* screening hospital* patient* anatom* biolog* species plant* tool* server* software* command*
meldung* gemeldet* gelöscht* bericht* klinik* gesundheit* regel* verboten* aufsatz geschicht* aufklärung* studie* arzt
denunci* inform* moderador* elimin* clínic* salud normas prohib* ensayo* histori* artículo* estudio*
signal* modérat* supprim* clinique* santé règle* interdi* essai* rapport* histoire* étude*
"""
#: Words for groups of people and the words that speak of a whole group.
GROUPS = """
people* they them their those these all every everyone migrant* immigrant* foreigner* refugee* nation* race* tribe* jew jews jewish muslim* christian* hindu* black blacks white whites asian* arab* african* gay gays lesbian* trans roma gyps* women disabled minority minorities
leute volk die alle diese ausländer* flüchtling* migrant* juden muslim* schwarze*
gente ellos todos esos inmigrante* extranjero* judío* musulman* pueblo
gens eux tous ils ces immigré* étranger* juif* musulman* peuple
"""
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deiner deinen deinem ihr euch euer tú tu te ti tus eres usted vosotros toi ton ta tes vous votre vos"
FIRST_PERSON = "i my me ich mein meine mich yo mi je mon ma mes"
#: Letters of other scripts that look like Latin ones, and characters written for letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x"}
LEET = {"4": "a", "@": "a", "3": "e", "!": "i", "1": "i", "0": "o", "5": "s", "$": "s", "7": "t"}
