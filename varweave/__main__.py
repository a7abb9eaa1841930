from varweave.cli import main

raise SystemExit(main())
