"""Whole licence texts by the SHA-256 of their canonical form (licenses.canonical); several wordings or titles of one licence
have several digests. Taken from the licence files of installed packages: wordings that stand in several of them, or in the
system's own collection. Texts into which projects write names, as BSD ones, are known without such names only."""

DIGESTS = (
    ("0BSD", "25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c"),
    ("0BSD", "5b0e126b4b198b16508de40a5730f547252a552266d5ccea7147be94a4b37d30"),
    ("Apache-2.0", "6074c3536c43b739207170b87d1681477d0f07374ed3d862ba461334cce848e3"),
    ("Apache-2.0", "bd09e549e7578b9b5073158daf8b07e41b9041cdd9722250dc9f8cb1d15e325a"),
    ("Apache-2.0", "d7dd8e5c661e35d656a43688fc21624b0ba52216e4c419c747129bf83780d165"),
    ("Apache-2.0", "d849700f6ffe2241c4de5c4f77cc6ee7a152ddfbb1ec7385106677e743be07a7"),
    ("Apache-2.0", "e7c5260ee7e187aa32deaf9fe84733b5dbe1dd1f3c36f232c49799c716b73570"),
    ("Apache-2.0", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe"),
    ("Apache-2.0", "fb388936c12fba660a278043424b3f9a17c6b2e536674e390813ac3d06e7e73a"),
    ("BSD-2-Clause", "312ea33736a8c485e221afd61fb0daddefb5517d78cb2d80a94cb23bf274bf84"),
    ("BSD-2-Clause", "456ec3a7c251c4a46d130d1988b6fa0221b8b1ee4f5b5a3fe9bb2e06a7910625"),
    ("BSD-2-Clause", "6a7760d565a49575b52f4990e284bd4419dfe3c9d33dfb85ba68966c3dc9e255"),
    ("BSD-2-Clause", "7061202489ba206b35e1e020fd1633db8013b98790929b974f0e3296ddb2e148"),
    ("BSD-2-Clause", "afcbf3f8a7fc036e82f2d6933551902c77680dafb511ba0af88cecccbe4e5a40"),
    ("BSD-2-Clause", "b0fcaedf8232d7d5f05d7dffa9a6329f53e92d4a6e5b22ea857715c80806c2ad"),
    ("BSD-3-Clause", "2e0decbba070abc582d86f6fb10e9524fced9606156f0aa9a188f297452f7e39"),
    ("BSD-3-Clause", "70c3476dc8fb69f1a53c0a71f83781d002749805cfae63d17831d12b99460e5d"),
    ("BSD-3-Clause", "8403a35ce9fc298cc5cfdf4409fcc23cdd773c206bcb9ed6e71a26a589c9eb7c"),
    ("BSD-3-Clause", "f2644f2bbb033dd10afc923af0a307710716b5657744726a934ef5e2bd28b4c1"),
    ("BSL-1.0", "6c9c7bd670990e58921b6c65c21c87a01a6059f061f30cd40dc83dd10878af5f"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "4bad57269926caf744f7416a9b0a6cc44aa837b7aa540446df8326a6691926f1"),
    ("GFDL-1.3", "8c86bde9dc6cd5ab057ab6dc16d40252322cbae59818a5db5162d4f6611c7597"),
    ("GPL-1.0", "9f835e8d27255e919724c64ac9d7899432c12249e03c140701ef4549a068729f"),
    ("GPL-2.0", "da9748830f1549aebe17266832927a9f736ae969233c3868ec0333c207a80a59"),
    ("GPL-3.0", "26d66f2c791a05ec9bb0e17d53bc437dba2d968e6f3faa3f7c4d4a472496e538"),
    ("GPL-3.0", "5e5be2b6e3bd876d53a98aa345dbd461ef477184338c0168dcc65cddeab3cc45"),
    ("ISC", "217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a"),
    ("ISC", "22545e516c83831353f0541d130d7e8581032e9aa39abd000c66edd902324e63"),
    ("ISC", "4a534a390ab5e338c580e11af44431d145cdb45b9289798abe97c23e8fdb93b2"),
    ("ISC", "5159709c2ad232960d349d0243a2fccf00a70bf2122b36ff3fa86f251300567a"),
    ("ISC", "63baaf2854baf0bb2e682f11a1853fb567b1e4cc0321733264b9b1cea90dc48d"),
    ("ISC", "88b7717fcdd81146db5806f169a2882599b1b6575d65b88971edaa913b7dbfa4"),
    ("ISC", "c5dc770cabaf67c4e40df556cd21a11490abf264e58fb6ccae81eb1d8ad9d455"),
    ("LGPL-2.0", "c84edc16db980cc5d2d24d3613da7234aaf265158bc83e96648da9c30fc9538b"),
    ("LGPL-2.1", "c117902a759f356dbf91a1262690e563a9082765acb2b0d81f9bc8801540aeff"),
    ("LGPL-3.0", "13980739d6423be0921994d8ce3ce547437735b0e6733161f70b19c962f194b7"),
    ("MIT", "0e405966af981833a82b8e6e84ba9a53c0acaf87b23481d90352968ccdcc78a7"),
    ("MIT", "0ec78a7468649ccd459d9303043a3efa85fd137ccefb13e20d76d37d9e27fb12"),
    ("MIT", "25dfbe3d84d39b93b823fd7c11d5c0a580c80d2a01d93099d9efd223cf9016a8"),
    ("MIT", "29d801472419ec4526ca9e6983d0bc80a527033f2b6ac9009a9ebe3b9ef7abd4"),
    ("MIT", "3263ad3325d079ab5ab5ecd06a5345c4c349de76956749d72cf6ac8bf6590985"),
    ("MIT", "37dc391091496e70bca3d02178bb9ac06511863b415ee59beb9a01f98f90848b"),
    ("MIT", "3befc985d2259cd020dad43f5a9cd62e18b7173a1943db7038ac1bec6efb7fd4"),
    ("MIT", "52f4d43e944263ac9d95d7264b5297391ad2bc90cfad85d384d04abdbdebee40"),
    ("MIT", "602556cb49dcc20b0835a09d976d5053c0d581a8ce1af13d8ba04878bb3e34e5"),
    ("MIT", "69199db379a9275c7bcf7ff52355074e0cc20130b6bc2588fff41f4a81bf548d"),
    ("MIT", "78a904b8636ea753a16cbcf6883a71e44fc3b8116fa0cdd2ab3da9c91dd38520"),
    ("MIT", "9702e4a5215fcc603c799de481739e48d87405fa3a054ee5c4593a1c02322f69"),
    ("MIT", "9fb5ab9a2c2a5a2ce226b51a963d48ef7455bc0ef4c968bc7f40973e7a39aa93"),
    ("MIT", "a002c0b89c89d1de006180b90a1b13658758e75578337256a577bdd46e089792"),
    ("MIT", "aacbe7d09238ff379d186933ac9d07d9227ef28f76dbdd3b3e25283bac9315cc"),
    ("MIT", "ea24978eb0436d4dbd1d2d80d67b039ce5a334966422e1fb42019849b9227c84"),
    ("MIT", "f306abc5201541771ea20067d30ec78d42631ae13fdf9c42226e985da549bd8a"),
    ("MPL-1.1", "979f7243204c7078aaa4d4e66ddf86160e3bfb3a2d6271273e461dc82f604699"),
    ("MPL-2.0", "58c01de89e5e2e39ba591a6a436e2d30c2ee15a95a58d2f71387f2762e72fcb9"),
    ("Unlicense", "e2380bdfe57ca73b01d0b1848a4ee630998d729b260e63082b9267100b4a7229"),
    ("Zlib", "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7"),
)
