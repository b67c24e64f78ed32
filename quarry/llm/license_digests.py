"""Digests of whole long licence texts, which need no texts here.

Fixed values: SHA-256 of the canonical form (license_scan.canonical) of the published
texts; several digests of one licence are its published wordings (with and without
appendix, addresses). A change of the canonical form changes them: license_scan.canonical
over the published texts gives them anew.
"""

DIGESTS = (
    ("AGPL-3.0", "4852776855bb71387e360d4f37fd80ec81760e340bd51e973e21c218545fdbed"),
    ("Apache-2.0", "160abd1ce958c5a605580b4bcf5f3e05f49d4c3a99226115665e56b10b6b0105"),
    ("Apache-2.0", "29d0c0f694979701dd52534d5d69d609d14f6a053b421e2fafb56771894aa3bf"),
    ("Apache-2.0", "9782099b6b13d659693083eb4b0ff3953507de47b5b3b9e194156468c52a8c1b"),
    ("Apache-2.0", "baaeb9ecb74a853c36866b9258f78b2353e0ff217b125408a812d13c7b84ae93"),
    ("Apache-2.0", "d201a388b8dffb1af762891a98996a5ca984f12eb3fe0cd3016f2827948d515b"),
    ("Apache-2.0", "df476296457b3b0963fd7ef4fa8de54d8dc96cbd38af6a45bbd66835652a12f5"),
    ("Artistic-1.0", "50cd294a1f03da474a09c58d35e8078f45a5f25fe34ce03806cf2d892e193184"),
    ("Artistic-2.0", "06f504520cf860b13102335db6971517e6659853845318421692ecaffa9341da"),
    ("BSL-1.0", "5fcf89bde8c0c2deb999f4cc626e1aebf90e80fdc5cd334dae008152ef4a1ded"),
    ("BlueOak-1.0.0", "41f406b31c5f6b0e46040fcf4fe74d21ba7f751b1b699d2d4abd5028327f1c3e"),
    ("BlueOak-1.0.0", "4f4a7096b4344c64eb46d031821945cbe710a21617839de2d535ef300f164749"),
    ("CC0-1.0", "de4b88a2c819a4661af54f735069ed878216da8b4992b919b84afa18cfc0e54c"),
    ("GFDL-1.2", "2a33851254c20d9a0107292cd31a941c4250bf90bea02cf44c08de88bdd70636"),
    ("GFDL-1.3", "91f6633c0c562d457bb02883113becc631a9bfc2f70df4f7b2d09a922a4bf08e"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "42a2063beecb82de51a227e52a22e4acf4fa0d052827262e6bb57835e02e10e9"),
    ("GPL-2.0", "724c8299687866f11de217ce9f08e16805bc84b71e66d8c4ea1307d371e33a4f"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "9faf4f9b13ca844eeee37346a77dec74f558096ac2b418782a99c8afe4c772da"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "77a17c8586ad4a15f4c4a26f2d3ce87ea2e9ddfba1f8d2b714dd33eb7a1f65f6"),
    ("LGPL-2.0", "baade1633fe30a430b0d265948d7aaaff603020348193a33c1018dada0d89004"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
    ("WTFPL", "067bdb797cf86dc4a0b000155ee79caac0a641773169d0b45f2c7e2d1c0e6b79"),
    ("WTFPL", "6504a63d8f35e97004cdcf0bcc852af5891be7aa7ff644665f6d9de2c696bfd9"),
)
